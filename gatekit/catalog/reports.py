"""Queries that aggregate gated cases and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import decisions as D
from ..operators import metrics as M
from ..operators import prepare as P
from ..sources import views as V
from . import sql as S
from .preparation import SCENARIO_SQL
from .registry import query
from .routes import METHODS_SQL, _guards_sql, guard_rows, labelled, routes


def rounded(df, *keep):
    """Round the double columns of a small result."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[r6(F.col(c)).alias(c) if c in doubles and c not in keep else F.col(c) for c in df.columns])


@query(
    "gate_metrics",
    S.SCORED
    + """select segment, count(*)::bigint as n, round(avg((y_true = y_pred)::int), 6) as accuracy, round(avg(case when action = 'accept' then (y_true = y_pred)::int end), 6) as accepted_accuracy,
    round(avg((action = 'accept')::int), 6) as coverage, round(avg((action = 'defer_to_human')::int), 6) as defer_rate, round(avg((action = 'block')::int), 6) as block_rate,
    round(avg((action = 'request_more_data')::int), 6) as request_rate, round(avg(chi_r_crit::int), 6) as diagnostic_rate, round(avg(i), 6) as mean_interpretability
    from scored group by segment""",
)
def gate_metrics(spark, sf):
    return rounded(M.gate_metrics(V.scored_cases(spark, sf), ["segment"], diagnostics=F.col("chi_r_crit")))


@query(
    "cost_metrics",
    S.SCORED
    + """select segment, round(avg(c), 6) as cost_before, round(avg(a), 6) as cost_after, round(avg(c) - avg(a), 6) as reduction from (
    select segment, c, case when action in ('accept', 'lower_confidence') then c when action = 'request_more_data' then 0.06e0 when action = 'block' then 0.08e0 else 0.10e0 end as a
    from (select *, case when y_true = y_pred then 0e0 when y_true = 1 then 5e0 else 1e0 end as c from scored)) group by segment""",
)
def cost_metrics(spark, sf):
    return rounded(M.cost_metrics(V.scored_cases(spark, sf), [[0.0, 1.0], [5.0, 0.0]], ["segment"]))


_POLICY_OUT = """count(*)::bigint as n, round(avg((action = proxy)::int), 6) as agreement_proxy, round(avg((action = ref)::int), 6) as agreement_reference,
    count(*) filter (where chi_r_crit and action <> 'block')::bigint as missed_critical,
    round(case when count(*) filter (where chi_r_crit) = 0 then 1e0 else count(*) filter (where chi_r_crit and action = 'block') / (count(*) filter (where chi_r_crit))::double end, 6) as critical_recall,
    round(avg((action in ('accept', 'lower_confidence') and not auto)::int), 6) as false_auto_accept_rate, round(avg((action = 'block' and not chi_r_crit)::int), 6) as false_block_rate,
    round(avg((action in ('accept', 'lower_confidence'))::int), 6) as auto_coverage"""


@query(
    "policy_metrics",
    _guards_sql("native").rsplit("select case_id", 1)[0]
    + ", wide as (select *, "
    + _guards_sql("native").rsplit("select case_id, ", 1)[1].replace("from gd, qq", f", {S.proxy()} as proxy, {S.reference()} as ref from gd, qq)")
    + """, long as (select *, 'threshold' as policy, threshold as act from wide union all select *, 'magnitude', magnitude from wide
    union all select *, 'mixed_sign', mixed_sign from wide union all select *, 'anchor', anchor from wide)
select policy, """
    + _POLICY_OUT
    + " from (select * exclude (action), act as action from long) group by policy",
)
def policy_metrics(spark, sf):
    from ..functions import gates as G

    gated = D.baseline_gates(guard_rows(spark, sf), "native")
    args = (F.col("p"), F.col("u"), F.col("interpretability"), F.col("chi_r"), F.col("chi_r_crit"))
    gated = gated.withColumn("proxy_action", G.proxy_action(*args)).withColumn(
        "reference_action", G.reference_action(*args, F.col("y_true") != F.col("y_pred"))
    )
    long = D.long_actions(gated, {n: F.col(n) for n in ("threshold", "magnitude", "mixed_sign", "anchor")})
    return rounded(M.policy_metrics(long))


@query(
    "observer_metrics",
    S.EVALUATION + f", lab as (select *, {S.proxy()} as proxy, {S.reference()} as ref from ev) select segment, {_POLICY_OUT} from lab group by segment",
)
def observer_metrics(spark, sf):
    return rounded(M.policy_metrics(labelled(spark, sf), by=("segment",)))


@query(
    "set_agreement",
    SCENARIO_SQL
    + f""", g as (select *, {S.full_gate(rho=S.clip('0.3e0 * p + 0.25e0 * u + 0.2e0 * (1 - i) + 0.15e0 * dd + 0.1e0 * s_r::int'), d='dd', r='s_r', c='s_c', a='s_a', t='s_t')} as act from sr)
select scenario, round(avg((act = allowed[1])::int), 6) as agreement_strict, round(avg(list_contains(allowed, act)::int), 6) as agreement_set,
    round(avg((act in ('accept', 'lower_confidence') and not list_contains(allowed, act))::int), 6) as false_auto_accept_rate, count(*) filter (where s_c and act <> 'block')::bigint as missed_critical
    from g group by scenario""",
)
def set_agreement(spark, sf):
    from ..functions import gates as G

    rows = P.expand_scenarios(V.evaluation_rows(spark, sf))
    p, u, i, d = F.col("p"), F.col("u"), F.col("interpretability"), F.col("reduction_loss")
    rows = rows.withColumn("rho", G.application_risk(p, u, i, d, F.col("chi_r")))
    action = G.gate_full(F.col("rho"), u, i, d, F.col("chi_r"), F.col("chi_r_crit"), F.col("chi_auto"), F.col("trace_valid"))
    return rounded(M.set_agreement(rows.withColumn("action", action), ["scenario"]))


OBJECTIVE_SQL = """round(count(*) filter (where chi_r_crit and action = 'block') / greatest(1, count(*) filter (where chi_r_crit))::double, 6) as recall_critical,
    count(*) filter (where chi_r_crit and action <> 'block')::bigint as missed_critical,
    count(*) filter (where action = 'accept' and (y_true <> y_pred or chi_r))::bigint as false_auto_accept,
    count(*) filter (where action = 'accept' and chi_r)::bigint as unsafe_accept,
    count(*) filter (where action = 'block' and y_true = y_pred and not chi_r and p < 0.35)::bigint as false_block,
    count(*) filter (where action = 'defer_to_human' and not chi_r and p < 0.35)::bigint as excessive_defer"""
OBJECTIVE_J = "5e0 * missed_critical + 3e0 * false_auto_accept + 2e0 * unsafe_accept + false_block + 0.5e0 * excessive_defer as objective"


@query(
    "objective_metrics",
    METHODS_SQL + f"select *, {OBJECTIVE_J} from (select method, {OBJECTIVE_SQL}, round(avg((action <> action_f0)::int), 6) as action_diff from mm group by method)",
)
def objective_metrics(spark, sf):
    return rounded(M.objective_metrics(D.comparison_gates(V.conflict_cases(spark, sf))))


@query(
    "level_summary",
    S.CONFLICTS
    + """, f as (select *, y_true <> y_pred as wrong from conf)
select count(*)::bigint as n_cases, count(distinct object_id)::bigint as n_objects, count(*) filter (where chi_r)::bigint as n_conflicts, count(*) filter (where chi_r_crit)::bigint as n_critical,
    count(*) filter (where action_f0 <> action_nas)::bigint as n_action_diff, count(*) filter (where action_f0 = 'accept' and action_nas = 'block')::bigint as n_accept_to_block,
    count(*) filter (where action_f0 = 'accept' and action_nas = 'defer_to_human')::bigint as n_accept_to_defer,
    count(*) filter (where action_f0 = 'accept' and (wrong or chi_r))::bigint as false_auto_f0, count(*) filter (where action_nas = 'accept' and (wrong or chi_r))::bigint as false_auto_nas,
    count(*) filter (where action_f0 = 'block' and not wrong and not chi_r and p < 0.35)::bigint as false_block_f0,
    count(*) filter (where action_nas = 'block' and not wrong and not chi_r and p < 0.35)::bigint as false_block_nas,
    round(avg(chi_r::int), 6) as share_conflicts, round(avg(chi_r_crit::int), 6) as share_critical, round(avg((action_f0 <> action_nas)::int), 6) as share_action_diff,
    round(avg((action_f0 = 'accept' and action_nas = 'block')::int), 6) as share_accept_to_block, round(avg((action_f0 = 'accept' and action_nas = 'defer_to_human')::int), 6) as share_accept_to_defer,
    round(count(*) filter (where chi_r_crit and action_nas = 'block') / greatest(1, count(*) filter (where chi_r_crit))::double, 6) as recall_critical_nas from f""",
)
def level_summary(spark, sf):
    return rounded(M.level_summary(V.conflict_cases(spark, sf)))


@query(
    "distribution",
    S.ROUTED + "select action, count(*)::bigint as count, round(count(*) * 100e0 / (select count(*) from routes), 2) as percentage from routes group by action",
)
def distribution(spark, sf):
    return M.distribution(routes(spark, sf), ["action"])


@query(
    "distribution_rollup",
    S.ROUTED
    + "select action, diagnostic_id, count(*)::bigint as count, round(count(*) * 100e0 / (select count(*) from routes), 2) as percentage from routes group by rollup (action, diagnostic_id)",
)
def distribution_rollup(spark, sf):
    return M.distribution(routes(spark, sf), ["action", "diagnostic_id"], rollup=True)


@query(
    "class_coverage",
    S.ROUTED
    + """, t as (select representation_class, string_agg(task_type, ';' order by task_type) as task_types from (select distinct representation_class, task_type from routes) group by 1),
x as (select representation_class, string_agg(case_id, ';' order by rn) as examples from (select *, row_number() over (partition by representation_class order by case_id) as rn from routes) where rn <= 3 group by 1)
select r.representation_class, count(*)::bigint as count, any_value(task_types) as task_types, any_value(examples) as examples from routes r join t using (representation_class) join x using (representation_class) group by 1""",
)
def class_coverage(spark, sf):
    return M.class_coverage(routes(spark, sf))


@query(
    "component_summary",
    S.ROUTED + "select dominant_component, count(*)::bigint as count, round(avg(rho), 6) as mean_rho, round(max(rho), 6) as max_rho from routes group by 1",
)
def component_summary(spark, sf):
    return M.component_summary(routes(spark, sf))


_CONTRIB = S.ROUTED + """, v as (select case dominant_component when 'gamma' then 'uncertainty' when 'delta' then 'reduction' else dominant_component end as dom,
    case when uncertainty = 0 then gamma else uncertainty end as uncertainty, delta as reduction, quality, conflict, interval_w from routes),
l as (select 'uncertainty' as component, uncertainty as x, dom from v union all select 'reduction', reduction, dom from v union all select 'quality', quality, dom from v
    union all select 'conflict', conflict, dom from v union all select 'interval', interval_w, dom from v)
select component, round(avg(x), 6) as mean_value, round(stddev_pop(x), 6) as std_value, count(*) filter (where dom = component)::bigint as dominance_count,
    round(count(*) filter (where dom = component) / count(*)::double, 6) as dominance_rate, round(avg(greatest(0e0, x - 0.25e0)), 6) as mean_excess, round(max(x), 6) as max_value from l group by component"""


@query("contribution_summary", _CONTRIB)
def contribution_summary(spark, sf):
    r = routes(spark, sf).select(
        "uncertainty", F.col("delta").alias("reduction"), "quality", F.col("conflict_component").alias("conflict"), F.col("interval_width").alias("interval"),
        "gamma", "delta", "dominant_component",
    )
    return M.contribution_summary(r)


@query(
    "model_summary",
    S.ROUTED
    + """, da as (select model_name, action, row_number() over (partition by model_name order by count(*) desc, action) as rn from routes group by 1, 2),
dc as (select model_name, dominant_component, row_number() over (partition by model_name order by count(*) desc, dominant_component) as rn from routes group by 1, 2)
select r.model_name, count(*)::bigint as n, round(avg(gamma), 6) as mean_gamma, round(avg(delta), 6) as mean_delta, round(avg(rho), 6) as mean_rho,
    count(*) filter (where r.action = 'audit')::bigint as audit_count, any_value(da.action) as dominant_action, any_value(dc.dominant_component) as dominant_risk_component
    from routes r join da on r.model_name = da.model_name and da.rn = 1 join dc on r.model_name = dc.model_name and dc.rn = 1 group by r.model_name""",
)
def model_summary(spark, sf):
    return M.model_summary(routes(spark, sf))


@query(
    "class_atlas",
    S.ROUTED
    + """, c as (select task_type, perturbation, representation_class, count(*) as k, row_number() over (partition by task_type, perturbation order by count(*) desc, representation_class) as rn from routes group by 1, 2, 3)
select task_type, perturbation, max(case when rn = 1 then representation_class end) as common_class, sum(k)::bigint as n from c group by 1, 2""",
)
def class_atlas(spark, sf):
    return M.class_atlas(routes(spark, sf))


_SERIES = """round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(quantile_cont(x, 0.5e0), 6) as median, round(quantile_cont(x, 0.25e0), 6) as p25,
    round(quantile_cont(x, 0.75e0), 6) as p75, round(quantile_cont(x, 0.05e0), 6) as p05, round(quantile_cont(x, 0.95e0), 6) as p95"""


@query("series_stats", S.SCORED + f"select {_SERIES} from (select rho as x from scored)")
def series_stats(spark, sf):
    return rounded(M.series_stats(V.scored_cases(spark, sf), "rho"))


@query(
    "quantile_digest",
    S.SCORED + "select round(avg(i), 6) as mean, round(quantile_cont(i, 0.5e0), 6) as median, round(quantile_cont(i, 0.05e0), 6) as q05, round(quantile_cont(i, 0.95e0), 6) as q95 from scored",
)
def quantile_digest(spark, sf):
    return rounded(M.quantile_digest(V.scored_cases(spark, sf), "interpretability"))


_CLS = S.ctes(S.CASES) + """, k as (select count(*) as n, count(*) filter (where y_true = 1 and y_pred = 1) as tp, count(*) filter (where y_true = 0 and y_pred = 1) as fp,
    count(*) filter (where y_true = 1 and y_pred = 0) as fn, avg((y_true = y_pred)::int) as acc from cases),
sc as (select p, count(*) filter (where y_true = 1) as pos, count(*) filter (where y_true = 0) as neg from cases group by p),
cu as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below from sc),
auc as (select sum(pos * (below + neg / 2e0)) / (sum(pos)::double * sum(neg)) as a from cu)
select n::bigint as n, round(acc, 6) as accuracy, round(tp / (tp + fp)::double, 6) as precision, round(tp / (tp + fn)::double, 6) as recall, round(2 * tp / (2 * tp + fp + fn)::double, 6) as f1,
    round(a, 6) as roc_auc from k, auc"""


@query("classification_metrics", _CLS)
def classification_metrics(spark, sf):
    return rounded(M.classification_metrics(V.cases(spark, sf)))


@query(
    "macro_metrics",
    """with l as (select l_linenumber % 4 as t, case when l_discount < 0.05 then l_linenumber % 4 else l_partkey % 4 end as h from lineitem),
c as (select distinct t as cls from l union select distinct h from l),
m as (select cls, count(*) filter (where t = cls and h = cls) as tp, count(*) filter (where t = cls) as a, count(*) filter (where h = cls) as q from l, c group by cls)
select (select count(*) from l)::bigint as n, round((select avg((t = h)::int) from l), 6) as accuracy, round(avg(case when q = 0 then 0e0 else tp / q::double end), 6) as precision,
    round(avg(case when a = 0 then 0e0 else tp / a::double end), 6) as recall, round(avg(case when a + q = 0 then 0e0 else 2 * tp / (a + q)::double end), 6) as f1 from m""",
)
def macro_metrics(spark, sf):
    lines = V.table(spark, sf, "lineitem")
    t = (F.col("l_linenumber") % 4).cast("int")
    h = F.when(F.col("l_discount") < 0.05, t).otherwise((F.col("l_partkey") % 4).cast("int"))
    return rounded(M.macro_metrics(lines.select(t.alias("y_true"), h.alias("y_pred"))))


@query(
    "boundary_distance",
    S.SCORED
    + """select nearest, count(*)::bigint as n, round(avg(a), 6) as to_accept, round(avg(b), 6) as to_audit from (select greatest(rho - 0.35, 0e0) as a, greatest(0.60 - rho, 0e0) as b,
    case when abs(rho - 0.35) <= abs(rho - 0.60) then 'accept' else 'audit' end as nearest from scored) group by nearest""",
)
def boundary_distance(spark, sf):
    out = M.boundary_distance(V.scored_cases(spark, sf))
    return rounded(out.groupBy("nearest").agg(F.count("*").alias("n"), F.avg("to_accept").alias("to_accept"), F.avg("to_audit").alias("to_audit")))


@query(
    "wilson_interval",
    S.SCORED
    + """, k as (select segment, count(*) filter (where action = 'block') as s, count(*) as n from scored group by segment), z as (select *, s / n::double as q, 1.96e0 * 1.96e0 as zz from k)
select segment, round(greatest(0e0, ((q + zz / (2 * n)) / (1 + zz / n)) - 1.96e0 * sqrt((q * (1 - q) + zz / (4 * n)) / n) / (1 + zz / n)), 6) as low,
    round(least(1e0, ((q + zz / (2 * n)) / (1 + zz / n)) + 1.96e0 * sqrt((q * (1 - q) + zz / (4 * n)) / n) / (1 + zz / n)), 6) as high from z""",
)
def wilson_interval(spark, sf):
    counts = V.scored_cases(spark, sf).groupBy("segment").agg(F.count_if(F.col("action") == "block").alias("s"), F.count("*").alias("n"))
    ci = counts.withColumn("ci", M.wilson_interval(F.col("s"), F.col("n")))
    return ci.select("segment", r6(F.col("ci.low")).alias("low"), r6(F.col("ci.high")).alias("high"))
