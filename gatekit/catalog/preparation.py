"""Queries over reading, checking and preparing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..operators import contracts as C
from ..operators import prepare as P
from ..sources import tables as T
from ..sources import views as V
from . import sql as S
from .registry import query


@query(
    "read_table",
    "select l_returnflag, l_linestatus, count(*)::bigint as n, round(sum(l_quantity), 6) as quantity from lineitem group by all",
)
def read_table(spark, sf):
    df = T.read_table(spark, f"{sf}/lineitem.parquet")
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), r6(F.sum("l_quantity")).alias("quantity"))


def _last_sql(name: str, source: str, column: str) -> str:
    few = f"count(distinct {column}) <= greatest(20, floor(0.05e0 * count(*)))"
    return f"select '{name}' as name, case when {few} then '{column}' end as guess, count(*)::bigint as n_rows from {source}"


@query(
    "guess_target",
    "select 'by name' as name, 'label' as guess, count(*)::bigint as n_rows from embeddings union all "
    + _last_sql("few values", "lineitem", "l_linestatus") + " union all " + _last_sql("many values", "orders", "o_orderkey"),
)
def guess_target(spark, sf):
    tables = {
        "by name": V.table(spark, sf, "embeddings"),
        "few values": V.table(spark, sf, "lineitem").select("l_orderkey", "l_tax", "l_linestatus"),
        "many values": V.table(spark, sf, "orders").select("o_orderstatus", "o_orderkey"),
    }
    rows = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), F.lit(P.guess_target(df)).cast("string").alias("guess"), "n_rows")
        for name, df in tables.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_PAYLOAD_ERRORS = S.ctes(S.CASES) + """
select case_id, concat_ws(';',
    case when line = 7 then 'model_name:missing' end,
    case when (case when tax >= 0.08 then p + 1e0 else p end) > 1 then 'class_probability:not_unit' end,
    case when line = 6 then 'feature_values:not_object' end) as errors
from cases"""


@query("validate_payloads", _PAYLOAD_ERRORS)
def validate_payloads(spark, sf):
    return C.validate_payloads(V.payloads(spark, sf)).select("case_id", F.array_join("errors", ";").alias("errors"))


@query(
    "quarantine_payloads",
    S.ctes(S.CASES)
    + """select count(*) filter (where ok)::bigint as n_valid, count(*) filter (where not ok)::bigint as n_quarantine
    from (select line not in (6, 7) and not (tax >= 0.08 and p + 1e0 > 1) as ok from cases)""",
)
def quarantine_payloads(spark, sf):
    checked = C.validate_payloads(V.payloads(spark, sf))
    return checked.agg(
        F.count_if(F.size("errors") == 0).alias("n_valid"), F.count_if(F.size("errors") > 0).alias("n_quarantine")
    )


@query(
    "flatten_payloads",
    S.ctes(S.CASES, S.PAYLOADS)
    + """select case_id, model_name, task_type, perturbation, round(cp, 6) as p, round(missing_rate, 6) as missing_rate,
    conflict as conflict_component, interval_w as interval_width, noise as signal_noise, occlusion as image_noise from pay""",
)
def flatten_payloads(spark, sf):
    valid = C.split_valid(C.parse_payloads(V.payloads(spark, sf))).valid
    return valid.select(
        "case_id", "model_name", "task_type", "perturbation", r6(F.col("class_probability")).alias("p"),
        r6(F.col("missing_rate")).alias("missing_rate"), "conflict_component", "interval_width", "signal_noise", "image_noise",
    )


@query(
    "validate_cases",
    S.ctes(S.CASES)
    + """select case_id, concat_ws(';', case when p < 0 or p > 1 then 'p must be in [0,1]' end,
    case when tax * 13 > 1 then 'load must be in [0,1]' end) as errors from cases""",
)
def validate_cases(spark, sf):
    rows = V.cases(spark, sf).select("case_id", "p", (F.col("tax") * 13).alias("load"), "extendedprice")
    return C.validate_cases(rows, ("p", "load")).select("case_id", F.array_join("errors", ";").alias("errors"))


@query(
    "profile_table",
    """select count(*)::bigint as n_rows, 4::bigint as n_columns, round((avg((l_tax > 0.07)::int) / 4), 6) as missing_rate,
    true as has_intervals, false as has_multiple_experts, 'u_int;u_ling;u_num;u_trace' as tags from lineitem""",
)
def profile_table(spark, sf):
    lines = V.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("size_min"), F.col("l_extendedprice").alias("size_max"),
        F.when(F.col("l_tax") <= 0.07, F.col("l_tax")).alias("tax"), "l_returnflag",
    )
    return P.profile_table(lines).select(
        "n_rows", F.col("n_columns").cast("long").alias("n_columns"), r6(F.col("missing_rate")).alias("missing_rate"),
        "has_intervals", "has_multiple_experts", F.array_join("tags", ";").alias("tags"),
    )


_IMPUTED = """with t as (select case when l_discount >= 0.02 then l_tax end as tax, case when l_quantity < 40 then l_quantity end as quantity,
    case when l_returnflag <> 'A' then l_returnflag end as flag, l_linestatus from lineitem),
m as (select quantile_cont(tax, 0.5) as mt, quantile_cont(quantity, 0.5) as mq from t)"""


@query(
    "impute",
    _IMPUTED
    + """select coalesce(flag, 'unknown') as flag, l_linestatus, count(*)::bigint as n, round(sum(coalesce(tax, mt)), 6) as tax,
    round(sum(coalesce(quantity, mq)), 6) as quantity from t, m group by 1, 2""",
)
def impute(spark, sf):
    lines = V.table(spark, sf, "lineitem").select(
        F.when(F.col("l_discount") >= 0.02, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("flag"),
        "l_linestatus",
    )
    return P.impute(lines).groupBy("flag", "l_linestatus").agg(
        F.count("*").alias("n"), r6(F.sum("tax")).alias("tax"), r6(F.sum("quantity")).alias("quantity")
    )


@query(
    "one_hot",
    """select sum((l_returnflag = 'A' and l_tax > 0.01)::int)::bigint as flag_A, sum((l_returnflag = 'N' and l_tax > 0.01)::int)::bigint as flag_N,
    sum((l_returnflag = 'R' and l_tax > 0.01)::int)::bigint as flag_R, sum((l_tax <= 0.01)::int)::bigint as flag_nan from lineitem""",
)
def one_hot(spark, sf):
    lines = V.table(spark, sf, "lineitem").select(F.when(F.col("l_tax") > 0.01, F.col("l_returnflag")).alias("flag"))
    coded = P.one_hot(lines, ["flag"], dummy_na=True)
    return coded.agg(*[F.sum(c).alias(c) for c in coded.columns])


@query(
    "encode_label",
    """with l as (select o_orderpriority, (dense_rank() over (order by o_orderpriority) - 1)::bigint as code from (select distinct o_orderpriority from orders))
    select o.o_orderpriority as label, code as label_code, count(*)::bigint as n from orders o join l using (o_orderpriority) group by 1, 2""",
)
def encode_label(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"))
    return P.encode_label(orders, "label").groupBy("label", "label_code").agg(F.count("*").alias("n"))


@query(
    "binarize_at_median",
    """select l_linestatus, (l_extendedprice >= (select quantile_cont(l_extendedprice, 0.5) from lineitem))::bigint as risk_target, count(*)::bigint as n
    from lineitem group by 1, 2""",
)
def binarize_at_median(spark, sf):
    lines = V.table(spark, sf, "lineitem").select("l_linestatus", "l_extendedprice")
    return P.binarize_at_median(lines, "l_extendedprice").groupBy(
        "l_linestatus", F.col("risk_target").cast("long").alias("risk_target")
    ).agg(F.count("*").alias("n"))


@query(
    "stratified_split",
    S.ctes(S.CASES)
    + f""", h as (select y_true, {S.uniform(42, "case_id")} as u from cases),
r as (select *, rank() over (partition by y_true order by u) - 1 as k, count(*) over (partition by y_true) as n from h)
select y_true::bigint as y_true, case when k < ceil(n * 0.25e0) then 'test' when k < ceil(n * 0.4375e0) then 'validation' else 'train' end as split,
    count(*)::bigint as n, round(sum(u), 6) as draws from r group by 1, 2""",
)
def stratified_split(spark, sf):
    from ..functions.numeric import hash_uniform

    rows = V.cases(spark, sf).select("case_id", "y_true")
    out = P.stratified_split(rows, "y_true", ["case_id"])
    return out.groupBy(F.col("y_true").cast("long").alias("y_true"), "split").agg(
        F.count("*").alias("n"), r6(F.sum(hash_uniform(42, F.col("case_id")))).alias("draws")
    )


@query(
    "data_card",
    """select count(*)::bigint as n_total, count(*) filter (where l_returnflag = 'R')::bigint as n_pos,
    count(*) filter (where l_returnflag <> 'R')::bigint as n_neg, round(avg((l_returnflag = 'R')::int), 6) as positive_rate from lineitem""",
)
def data_card(spark, sf):
    out = P.data_card(V.cases(spark, sf), "y_true")
    return out.withColumn("positive_rate", r6(F.col("positive_rate")))


_SCENARIOS = """, sc(scenario, s_r, s_c, s_a, s_t) as (values ('clean', false, false, true, true), ('rule_conflict', true, false, true, true),
    ('trace_gap', false, false, true, false), ('context_forbidden', false, false, false, true), ('source_conflict', true, false, false, true),
    ('high_reduction_loss', false, false, true, true), ('critical_rupture', true, true, false, true)),
sr as (select *, case when scenario = 'high_reduction_loss' then greatest(0.35e0, d0) else d0 end as dd,
    case when scenario = 'critical_rupture' then ['block']
         when scenario in ('rule_conflict', 'trace_gap', 'context_forbidden', 'source_conflict') then ['defer_to_human', 'request_more_data']
         when scenario = 'high_reduction_loss' then ['defer_to_human', 'lower_confidence', 'request_more_data']
         when p < 0.25 then ['accept', 'lower_confidence'] else ['defer_to_human', 'lower_confidence'] end as allowed
    from (select *, discount * 2.5e0 as d0 from scored), sc)"""
SCENARIO_SQL = S.SCORED + _SCENARIOS


@query(
    "expand_scenarios",
    SCENARIO_SQL
    + """select scenario, allowed[1] as expected_action, array_to_string(allowed, ';') as expected_actions, s_r as chi_r, s_a as chi_auto,
    count(*)::bigint as n, round(sum(dd), 6) as loss from sr group by 1, 2, 3, 4, 5""",
)
def expand_scenarios(spark, sf):
    out = P.expand_scenarios(V.evaluation_rows(spark, sf))
    return out.groupBy(
        "scenario", "expected_action", F.array_join("expected_actions", ";").alias("expected_actions"), "chi_r", "chi_auto"
    ).agg(F.count("*").alias("n"), r6(F.sum("reduction_loss")).alias("loss"))


@query(
    "rupture_flags",
    """select (l_returnflag <> 'R' or l_linestatus <> 'O' or l_tax >= 0.08) as chi_r, (l_linestatus <> 'O' or l_tax >= 0.08) as chi_r_crit, count(*)::bigint as n
    from lineitem group by 1, 2""",
)
def rupture_flags(spark, sf):
    lines = V.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("expert_a"), F.lit("R").alias("expert_b"), F.col("l_linestatus").alias("source_model"),
        F.lit("O").alias("source_expert"), (F.col("l_tax") >= 0.08).alias("is_critical"),
    )
    return P.rupture_flags(lines).groupBy("chi_r", "chi_r_crit").agg(F.count("*").alias("n"))


_TERM_COLUMNS = ("quantity", "extendedprice", "tax")
_TERMS_SQL = S.ctes(S.CASES) + """, long as (
    select 'quantity' as "column", quantity as v from cases union all select 'extendedprice', extendedprice from cases
    union all select 'tax', tax from cases union all select 'one', 1e0 from cases),
terms as (select "column", case when min(v) = max(v) then min(v) else quantile_cont(v, 0e0) end as q_min,
    case when min(v) = max(v) then min(v) + 0.25e0 else quantile_cont(v, 0.25e0) end as q25,
    case when min(v) = max(v) then min(v) + 0.5e0 else quantile_cont(v, 0.5e0) end as q_median,
    case when min(v) = max(v) then min(v) + 0.75e0 else quantile_cont(v, 0.75e0) end as q75,
    case when min(v) = max(v) then min(v) + 1e0 else quantile_cont(v, 1e0) end as q_max from long group by 1)"""


def _terms(spark, sf):
    rows = V.cases(spark, sf).withColumn("one", F.lit(1.0))
    return rows, P.fit_terms(rows, [*_TERM_COLUMNS, "one"])


@query(
    "fit_terms",
    _TERMS_SQL + """select "column", round(q_min, 6) as q_min, round(q25, 6) as q25, round(q_median, 6) as q_median, round(q75, 6) as q75, round(q_max, 6) as q_max from terms""",
)
def fit_terms(spark, sf):
    _, terms = _terms(spark, sf)
    return terms.select("column", *[r6(F.col(c)).alias(c) for c in P.QUARTILES])


@query(
    "apply_terms",
    _TERMS_SQL
    + """select case_id,
    round(case when quantity <= q_min then 1e0 when quantity >= q_median then 0e0 else (q_median - quantity) / greatest(q_median - q_min, 1e-12) end, 6) as quantity_low,
    round(case when quantity <= q25 or quantity >= q75 then 0e0 when abs(quantity - q_median) < 1e-12 then 1e0
        when quantity < q_median then (quantity - q25) / greatest(q_median - q25, 1e-12) else (q75 - quantity) / greatest(q75 - q_median, 1e-12) end, 6) as quantity_medium,
    round(case when quantity <= q_median then 0e0 when quantity >= q_max then 1e0 else (quantity - q_median) / greatest(q_max - q_median, 1e-12) end, 6) as quantity_high
    from cases, (select * from terms where "column" = 'quantity')""",
)
def apply_terms(spark, sf):
    rows, terms = _terms(spark, sf)
    out = P.apply_terms(rows.select("case_id", "quantity"), terms, ["quantity"])
    return out.select("case_id", *[r6(F.col(c)).alias(c) for c in ("quantity_low", "quantity_medium", "quantity_high")])


@query(
    "categorical_levels",
    """select distinct 'priority' as "column", o_orderpriority as value from orders union all select distinct 'customer', o_custkey::varchar from orders""",
)
def categorical_levels(spark, sf):
    orders = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    return P.categorical_levels(orders, ["priority", "customer"])
