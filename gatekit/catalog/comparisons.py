"""Queries that set policies, configs and samples side by side, and that read other formats."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions.numeric import clip01, hash_uniform, poisson1, r6, r6_scaled
from ..operators import metrics as M
from ..operators import prepare as P
from ..operators import rules as RU
from ..operators import stats as ST
from ..operators import sweeps as W
from ..session import checkpoint_root, materialised
from ..sources import tables as T
from ..sources import views as V
from . import sql as S
from .preparation import SCENARIO_SQL
from .registry import query
from .reports import OBJECTIVE_J, OBJECTIVE_SQL, rounded
from .routes import METHODS
from .rules_stats import _BOOT, _LOFO, _MAG, _RULES, _f1, _mcnemar_sql
from .sweeping import _CANDS, _SIMPLEX

# --- other formats ------------------------------------------------------------------------------

_ORDERS_SQL = """select o_orderpriority, count(*)::bigint as n, round(sum(o_totalprice), 4) as total, count(distinct o_custkey)::bigint as customers
    from orders group by 1"""
_ORDER_COLUMNS = "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double"


def _through(spark, sf, fmt: str):
    """Orders written in another format to the shared folder and read back."""
    path = f"{checkpoint_root(spark)}/orders-{uuid.uuid4().hex}.{fmt}"
    orders = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    T.write_table(orders, path, fmt)
    back = T.read_table(spark, path, schema=_ORDER_COLUMNS, **({"header": False} if fmt == "csv" else {}))
    return back.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 4).alias("total"), F.countDistinct("o_custkey").alias("customers")
    )


@query("read_csv", _ORDERS_SQL)
def read_csv(spark, sf):
    return _through(spark, sf, "csv")


@query("read_json_lines", _ORDERS_SQL)
def read_json_lines(spark, sf):
    return _through(spark, sf, "json")


# --- policies on scenarios ------------------------------------------------------------------------

def _terms() -> tuple:
    return F.col("p"), F.col("u"), F.col("interpretability"), F.col("reduction_loss")


def scenario_actions() -> dict:
    """Four gates: by probability, by the explanation alone, without diagnostics and loss, in full."""
    p, u, i, d = _terms()
    no_context = G.application_risk(p, u, i, F.lit(0.0), F.lit(False))
    full = G.application_risk(p, u, i, d, F.col("chi_r"))
    return {
        "threshold": F.when(p >= 0.70, "defer_to_human").when(p >= 0.35, "lower_confidence").otherwise("accept"),
        "operator": F.when(i >= 0.60, "accept").when(i >= 0.45, "lower_confidence").otherwise("defer_to_human"),
        "no_context": G.gate_simple(no_context, u, p, F.lit(False)),
        "full": G.gate_simple(full, u, p, F.col("chi_r")),
    }


def by_policy(rows, actions: dict):
    """Each row once per policy, a handful of literals."""
    pairs = F.array(*[F.struct(F.lit(k).alias("policy"), a.alias("action")) for k, a in actions.items()])
    return rows.select(*[c for c in rows.columns if c not in ("policy", "action")], F.inline(pairs))


_RHO = "0.3e0 * p + 0.25e0 * u + 0.2e0 * (1 - i)"
_GATES4 = SCENARIO_SQL + f""", g as (
    select *, 'threshold' as policy, case when p >= 0.7 then 'defer_to_human' when p >= 0.35 then 'lower_confidence' else 'accept' end as act from sr union all
    select *, 'operator', case when i >= 0.6 then 'accept' when i >= 0.45 then 'lower_confidence' else 'defer_to_human' end from sr union all
    select *, 'no_context', {S.simple_gate(S.clip(_RHO), 'u', 'p', 'false')} from sr union all
    select *, 'full', {S.simple_gate(S.clip(_RHO + ' + 0.15e0 * dd + 0.1e0 * s_r::int'), 'u', 'p', 's_r')} from sr)"""


@query(
    "scenario_gates",
    _GATES4 + """select policy, count(*)::bigint as n, round(avg((act = allowed[1])::int), 6) as accuracy,
    count(*) filter (where act = 'block' and allowed[1] in ('accept', 'lower_confidence'))::bigint as false_blocks,
    count(*) filter (where act in ('accept', 'lower_confidence') and allowed[1] = 'block')::bigint as missed_ruptures from g group by policy""",
)
def scenario_gates(spark, sf):
    rows = by_policy(P.expand_scenarios(V.evaluation_rows(spark, sf)), scenario_actions())
    a, e = F.col("action"), F.col("expected_action")
    return rows.groupBy("policy").agg(
        F.count("*").alias("n"), r6(F.avg((a == e).cast("int"))).alias("accuracy"),
        F.count_if((a == "block") & M.is_auto(e)).alias("false_blocks"), F.count_if(M.is_auto(a) & (e == "block")).alias("missed_ruptures"),
    )


_THRESHOLD_SQL = """case when s_c then 'block' when p >= 0.75 then 'defer_to_human' when u >= 0.45 or i < 0.65 then 'request_more_data'
    when p >= 0.35 then 'lower_confidence' else 'accept' end"""


@query(
    "set_agreement_policies",
    SCENARIO_SQL
    + f""", g as (select *, 'full' as policy, {S.full_gate(rho=S.clip(_RHO + ' + 0.15e0 * dd + 0.1e0 * s_r::int'), d='dd', r='s_r', c='s_c', a='s_a', t='s_t')} as act from sr
    union all select *, 'threshold', {_THRESHOLD_SQL} from sr)
select policy, round(avg((act = allowed[1])::int), 6) as agreement_strict, round(avg(list_contains(allowed, act)::int), 6) as agreement_set,
    round(avg((act in ('accept', 'lower_confidence') and not list_contains(allowed, act))::int), 6) as false_auto_accept_rate, count(*) filter (where s_c and act <> 'block')::bigint as missed_critical
    from g group by policy""",
)
def set_agreement_policies(spark, sf):
    """The full gate and a threshold gate against sets of acceptable actions."""
    p, u, i, d = _terms()
    rho = G.application_risk(p, u, i, d, F.col("chi_r"))
    actions = {
        "full": G.gate_full(rho, u, i, d, F.col("chi_r"), F.col("chi_r_crit"), F.col("chi_auto"), F.col("trace_valid")),
        "threshold": F.when(F.col("chi_r_crit"), "block").when(p >= 0.75, "defer_to_human").when((u >= 0.45) | (i < 0.65), "request_more_data")
        .when(p >= 0.35, "lower_confidence").otherwise("accept"),
    }
    return rounded(M.set_agreement(by_policy(P.expand_scenarios(V.evaluation_rows(spark, sf)), actions), ["policy"]))


# --- configs on validation and test ---------------------------------------------------------------

def _config_risk_sql(w: str = "") -> str:
    return S.clip(f"{w}w_p * p + {w}w_u * u_m + {w}w_i * (1 - i_pre) + {w}w_d * delta_m + {w}w_r * chi_r::int")


def _scored_sql(name: str, source: str, candidates: str) -> str:
    return f"""{name}_1 as (select c.*, k.p, k.y_true, k.y_pred, k.chi_r, k.chi_r_crit, k.rho_nas,
    {S.ladder(_config_risk_sql(), ('t1', 't2', 't3', 't4'), 'chi_r_crit')} as action from {source} k, {candidates} c),
{name}_2 as (select method, idx, any_value(w_p) as w_p, any_value(w_u) as w_u, any_value(w_i) as w_i, any_value(w_d) as w_d, any_value(w_r) as w_r, {OBJECTIVE_SQL},
    avg(least(abs(t1 - rho_nas), abs(t2 - rho_nas), abs(t3 - rho_nas), abs(t4 - rho_nas))) as margin from {name}_1 group by method, idx),
{name} as (select *, {OBJECTIVE_J}, -(w_p * ln(w_p + 1e-12) + w_u * ln(w_u + 1e-12) + w_i * ln(w_i + 1e-12) + w_d * ln(w_d + 1e-12) + w_r * ln(w_r + 1e-12)) as weight_entropy from {name}_2)"""


_BEST_ORDER = """objective, missed_critical, false_auto_accept, unsafe_accept, false_block, excessive_defer, round(weight_entropy, 9), round(-margin, 9), method, idx"""
_HALF = S.uniform(7, "case_id")
_SPLIT_SQL = S.ctes(
    S.conflicts(), _CANDS, f"va as (select * from conf where {_HALF} < 0.5e0),\nte as (select * from conf where {_HALF} >= 0.5e0)", _scored_sql("sv", "va", "cd"),
    f"best as (select method, idx from sv order by {_BEST_ORDER} limit 1)",
    "two as (select cd.*, 'best' as config from cd join best using (method, idx) union all select *, 'manual' from cd where method = 'manual')",
)


def _halves(spark, sf):
    cases = V.conflict_cases(spark, sf).withColumn("_u", hash_uniform(7, F.col("case_id")))
    return cases.where("_u < 0.5").drop("_u"), cases.where("_u >= 0.5").drop("_u")


def _two_configs(spark, sf, validation):
    """The manual and the best candidate, the latter by the validation part."""
    candidates = W.objective_candidates(spark)
    best = W.best_objective(W.calibrate_by_objective(validation, candidates)).select("method", "idx")
    manual = candidates.where("method = 'manual'").withColumn("config", F.lit("manual"))
    return candidates.join(best, ["method", "idx"]).withColumn("config", F.lit("best")).unionByName(manual)


_COUNTS = ("missed_critical", "false_auto_accept", "unsafe_accept", "false_block", "excessive_defer", "objective")


@query(
    "objective_on_splits",
    _SPLIT_SQL.rstrip() + ",\n" + _scored_sql("fv", "va", "(select * exclude (config), config from two)") + ",\n" + _scored_sql("ft", "te", "(select * exclude (config), config from two)")
    + f"""select config, part, {', '.join(_COUNTS)} from (
    select two.config, 'validation' as part, fv.* exclude (recall_critical) from two join fv using (method, idx) union all select two.config, 'test', ft.* exclude (recall_critical) from two join ft using (method, idx))""",
)
def objective_on_splits(spark, sf):
    """Manual and best config on the part they were chosen on and on the other part."""
    validation, test = _halves(spark, sf)
    two = materialised(_two_configs(spark, sf, validation))
    parts = []
    for name, rows in (("validation", validation), ("test", test)):
        scored = W.calibrate_by_objective(rows, two.drop("config").distinct())
        parts.append(two.select("config", "method", "idx").join(scored, ["method", "idx"]).withColumn("part", F.lit(name)))
    return parts[0].unionByName(parts[1]).select("config", "part", *_COUNTS)


# --- a partitioned table -----------------------------------------------------------------------------

def one_type_of_events(spark, sf):
    """Events written by type and day, then one type read back: a filter on the folders, not on the rows."""
    events = V.table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    path = f"{checkpoint_root(spark)}/events-{uuid.uuid4().hex}"
    # Rows of a folder meet in few files; days keep a type that is hot apart.
    T.write_table(events.repartition("event_type", "day"), path, partition_by=("event_type", "day"))
    return T.read_table(spark, path, "parquet").where(F.col("event_type") == "error")


@query(
    "partitioned_events",
    "select strftime(ts, '%Y-%m-%d') as day, count(*)::bigint as n, round(sum(value), 4) as total, count(distinct user_id)::bigint as users from events where event_type = 'error' group by 1",
)
def partitioned_events(spark, sf):
    back = one_type_of_events(spark, sf)
    return back.groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users")
    )


# --- paired tests --------------------------------------------------------------------------------------

@query("mcnemar_fml", _mcnemar_sql("action_f0", "action_fml"))
def mcnemar_fml(spark, sf):
    return rounded(ST.mcnemar(V.conflict_cases(spark, sf), "action_f0", "action_fml"))


@query("mcnemar_structure", _mcnemar_sql(METHODS["B6_equal_structure"], "action_nas"))
def mcnemar_structure(spark, sf):
    b6 = G.zone_ladder(clip01(0.50 * F.col("p") + 0.20 * F.col("u_m") + 0.20 * (1.0 - F.col("i_pre")) + 0.10 * F.col("delta_m")), G.CONFLICT_THETAS)
    return rounded(ST.mcnemar(V.conflict_cases(spark, sf).withColumn("b6", b6), "b6", "action_nas"))


def _config_action_sql(config: str) -> str:
    risk, t = _config_risk_sql(f"{config}."), tuple(f"{config}.t{i}" for i in (1, 2, 3, 4))
    return S.ladder(risk, t, "chi_r_crit")


@query(
    "mcnemar_configs",
    _SPLIT_SQL.rstrip() + f""",
pairs as (select object_id, chi_r_crit, {_config_action_sql('m')} = 'block' as ba, {_config_action_sql('b')} = 'block' as bb
    from conf, (select * from two where config = 'manual') m, (select * from two where config = 'best') b)"""
    + _mcnemar_sql("''", "''").split("from conf)", 1)[1].replace("from x group", "from pairs group"),
)
def mcnemar_configs(spark, sf):
    """The manual config against the best one, chosen on the validation part, over all cases."""
    validation, _ = _halves(spark, sf)
    configs = materialised(_two_configs(spark, sf, validation))
    cases = V.conflict_cases(spark, sf)
    for name in ("manual", "best"):
        fields = [*W.OBJECTIVE_WEIGHTS, "t1", "t2", "t3", "t4"]
        c = configs.where(F.col("config") == name).select(F.struct(*fields)).scalar()
        cases = cases.withColumn("_c", c)
        w = lambda k: F.col("_c")[k]
        rho = clip01(
            w("w_p") * F.col("p") + w("w_u") * F.col("u_m") + w("w_i") * (1.0 - F.col("i_pre")) + w("w_d") * F.col("delta_m") + w("w_r") * F.col("chi_r").cast("double")
        )
        cases = cases.withColumn(name, G.zone_ladder(rho, [w(f"t{i}") for i in (1, 2, 3, 4)], F.col("chi_r_crit"))).drop("_c")
    return rounded(ST.mcnemar(cases, "manual", "best"))


# --- rules and weights that are kept --------------------------------------------------------------------

@query(
    "rule_pruning",
    _BOOT + _LOFO.replace(S.ctes(_RULES), "") + _MAG + f""", bk as (select rule, row_number() over (order by top_frequency desc, round(mean_delta_f1, 12) desc, mean_rank, rule) as rk from bt),
tops as (select 'removal' as ranking, rule from lofo where rk <= 12 union all select 'magnitude', rule from mgr where rk <= 12 union all select 'bootstrap', rule from bk where rk <= 12),
sz as (select ranking, p.vec_id, p.y, sum(case when t.rule is not null then part else 0e0 end) >= 0 as q from (select distinct ranking from tops) r cross join pr p left join tops t using (ranking, rule) group by 1, 2, 3),
fs as (select ranking, {_f1('q')} as f1 from sz group by ranking),
ov as (select a.ranking, count(b.rule) / (24 - count(b.rule))::double as jaccard from tops a left join tops b on a.rule = b.rule and b.ranking = 'removal' group by 1)
select ranking, round(f1, 6) as f1, round(jaccard, 6) as overlap from fs join ov using (ranking)""",
)
def rule_pruning(spark, sf):
    """F1 of the twelve rules kept by removal, by magnitude and by the bootstrap, and how far each set agrees with removal."""
    rows = V.embeddings(spark, sf)
    tops = {
        "removal": RU.top_rules(RU.rule_importance_lofo(rows, V.THETA), 12),
        "magnitude": RU.top_magnitude(RU.rule_importance_magnitude(rows, V.THETA), 12),
        "bootstrap": RU.top_bootstrap(RU.rule_importance_bootstrap(rows, V.THETA, "vec_id"), 12),
    }
    parts = []
    for name, top in tops.items():
        overlap = RU.set_jaccard(tops["removal"], top).select("jaccard").scalar()
        parts.append(RU.subset_f1(rows, V.THETA, top).select(F.lit(name).alias("ranking"), r6(F.col("f1")).alias("f1"), r6(overlap).alias("overlap")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "best_simplex",
    _SIMPLEX.rsplit("select round(w1", 1)[0]
    + """select round(w1, 6) as predicted_risk, round(w2, 6) as uncertainty, round(w3, 6) as interpretability_gap, round(w4, 6) as reduction_loss, round(w5, 6) as diagnostic, round(accuracy, 6) as accuracy
    from z order by accuracy desc, round(mse, 12), round((w1 - 0.3e0) * (w1 - 0.3e0) + (w2 - 0.25e0) * (w2 - 0.25e0) + (w3 - 0.2e0) * (w3 - 0.2e0) + (w4 - 0.15e0) * (w4 - 0.15e0) + (w5 - 0.1e0) * (w5 - 0.1e0), 12), w1, w2, w3, w4, w5 limit 1""",
)
def best_simplex(spark, sf):
    """The weighting that calibration picks."""
    rows = V.evaluation_rows(spark, sf).select(
        "p", "u", "interpretability", "reduction_loss", "chi_r", "chi_r_crit", (F.col("y_true") != F.col("y_pred")).alias("wrong")
    )
    p, u, i, _ = _terms()
    expected = G.reference_action(p, u, i, F.col("chi_r"), F.col("chi_r_crit"), F.col("wrong"))
    best = W.best_simplex(W.calibrate_simplex(rows.withColumn("expected_action", expected), W.simplex_grid(spark)))
    return rounded(best.drop("mse", "distance").withColumn("accuracy", r6_scaled(F.col("accuracy"))))


# --- a sample with replacement beside the natural flow ----------------------------------------------------

@query(
    "sample_with_replacement",
    S.CONFLICTS + f""", x as (select *, 'natural' as flow, 1 as w from conf union all select *, 'drawn', {S.poisson(S.uniform(42, 'case_id'))} from conf)
select flow, sum(w)::bigint as n_cases, count(distinct case when w > 0 then object_id end)::bigint as n_objects, sum(w * chi_r::int)::bigint as n_conflicts, sum(w * chi_r_crit::int)::bigint as n_critical,
    sum(w * (action_f0 <> action_nas)::int)::bigint as n_action_diff, sum(w * (action_f0 = 'accept' and action_nas = 'block')::int)::bigint as n_accept_to_block from x group by flow""",
)
def sample_with_replacement(spark, sf):
    """Counts over all cases and over a draw with replacement, which is a number per case, not a copy of rows."""
    draw = poisson1(hash_uniform(42, F.col("case_id")))
    flows = F.array(F.struct(F.lit("natural").alias("flow"), F.lit(1).alias("w")), F.struct(F.lit("drawn").alias("flow"), draw.alias("w")))
    rows = V.conflict_cases(spark, sf).select("*", F.inline(flows))
    total = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0)).cast("long")
    f0, nas = F.col("action_f0"), F.col("action_nas")
    return rows.groupBy("flow").agg(
        F.sum("w").cast("long").alias("n_cases"), F.countDistinct(F.when(F.col("w") > 0, F.col("object_id"))).alias("n_objects"),
        total(F.col("chi_r")).alias("n_conflicts"), total(F.col("chi_r_crit")).alias("n_critical"),
        total(f0 != nas).alias("n_action_diff"), total((f0 == "accept") & (nas == "block")).alias("n_accept_to_block"),
    )
