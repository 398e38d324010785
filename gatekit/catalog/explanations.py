"""Queries over joined explanations and attributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import r6, r9, r10
from ..operators import attributions as A
from ..operators import compose as X
from ..sources import views as V
from . import sql as S
from .registry import query


def _pairs(spark, sf):
    return V.explanation_pairs(spark, sf)


@query("semantic_disagreement", S.PAIRED + "select case_id, round(gamma, 6) as gamma from pairs")
def semantic_disagreement(spark, sf):
    return X.disagreement(_pairs(spark, sf)).select("case_id", r6(F.col("gamma")).alias("gamma"))


@query(
    "disagreement_with_reduction",
    S.PAIRED
    + f"select segment, count(*)::bigint as n, round(avg({S.clip('0.27e0 * g_repr + 0.225e0 * g_rules + 0.135e0 * g_act + 0.18e0 * abs(ul - ur) + 0.09e0 * g_trace + 0.1e0 * least(1e0, delta_r)')}), 6) as mean_gamma from pairs group by segment",
)
def disagreement_with_reduction(spark, sf):
    from ..plans.plan import BETA

    # The reduction term takes a tenth, the other terms share the rest as before.
    beta = {term: 0.90 * weight for term, weight in BETA.items()} | {"reduction": 0.10}
    return X.disagreement(_pairs(spark, sf), beta).groupBy("segment").agg(F.count("*").alias("n"), r6(F.avg("gamma")).alias("mean_gamma"))


@query(
    "edge_report",
    S.PAIRED
    + """select case_id, round(gamma, 6) as gamma, case when gamma < 0.20 then 'green' when gamma < 0.45 then 'orange' else 'red' end as severity,
    concat_ws(';', case when a_high > 0.05 then 'r_high' end, case when a_low > 0.05 then 'r_low' end, case when a_medium > 0.05 then 'r_medium' end) as left_active,
    concat_ws(';', case when b_check > 0.05 then 'r_check' end, case when b_high > 0.05 then 'r_high' end, case when b_low > 0.05 then 'r_low' end) as right_active,
    round(delta_r, 9) as right_delta from pairs""",
)
def edge_report(spark, sf):
    return X.edge_report(_pairs(spark, sf)).select(
        "case_id", "gamma", "severity", F.array_join("left_active", ";").alias("left_active"),
        F.array_join("right_active", ";").alias("right_active"), r9(F.col("right_delta")).alias("right_delta"),
    )


@query(
    "compose_pair",
    S.PAIRED
    + """select case_id, case when returnflag = 'A' then 'no common terms' when gamma > 0.45 then 'disagreement above gamma_max' end as reason,
    case when returnflag = 'A' or gamma > 0.45 then null else round(1 - (1 - ul) * (1 - ur) * (1 - gamma), 6) end as u,
    case when returnflag = 'A' or gamma > 0.45 then null else round(least(1e0, delta_r), 9) end as loss,
    case when returnflag = 'A' or gamma > 0.45 then null else 4 end::bigint as n_rules,
    case when returnflag = 'A' or gamma > 0.45 then null else round(greatest(a_low, b_low), 6) end as act_low from pairs""",
)
def compose_pair(spark, sf):
    out = X.compose_pair(_pairs(spark, sf), gamma_max=0.45)
    return out.select(
        "case_id", "reason", r6(F.col("uncertainty")).alias("u"), r9(F.col("reduction_loss")).alias("loss"),
        F.when(F.col("rules").isNotNull(), F.size("rules").cast("long")).alias("n_rules"),
        r6(F.element_at("activations", F.lit("r_low"))).alias("act_low"),
    )


_CANDIDATES = [
    {"name": "same", "term_map": {"high_risk": "high_risk", "medium_risk": "medium_risk"}, "rule_map": {"r_high": "r_high", "r_low": "r_low"}},
    {"name": "checked", "term_map": {"medium_risk": "source"}, "rule_map": {"r_medium": "r_check", "r_high": "r_high"}, "activation_scale": 0.8},
    {"name": "other", "term_map": {"low_risk": "other_term"}, "rule_map": {"r_low": "r_low"}, "activation_scale": 0.5},
]
_ALIGN = S.PAIRED + """, c as (
    select case_id, 0 as pos, 'same' as name, least(1e0, (abs(a_high - b_high) + abs(a_low - b_low)) / 2 + 0.5e0 * (1 - 2 / 3e0) + 0.3e0 * (1 - 2 / 3e0)) as g,
        least(1e0, abs(0 - delta_r) + 0.25e0 * (1 - 2 / 3e0)) as d from pairs where returnflag <> 'A'
    union all select case_id, 1, 'checked', least(1e0, (abs(a_medium * 0.8e0 - b_check) + abs(a_high * 0.8e0 - b_high)) / 2 + 0.5e0 * (1 - 1 / 3e0) + 0.3e0 * (1 - 2 / 3e0)),
        least(1e0, abs(0 - delta_r) + 0.25e0 * (1 - 1 / 3e0)) from pairs where returnflag <> 'A'
    union all select case_id, 2, 'other', least(1e0, abs(a_low * 0.5e0 - b_low) + 0.5e0 * (1 - 1 / 3e0) + 0.3e0 * (1 - 1 / 3e0)),
        least(1e0, abs(0 - delta_r) + 0.25e0 * (1 - 1 / 3e0)) from pairs where returnflag = 'A'),
b as (select *, round(g + 0.2e0 * d, 6) as cost, row_number() over (partition by case_id order by round(g + 0.2e0 * d, 6), pos) as rn from c)
select case_id, name as alignment, round(g, 6) as gamma, round(d, 6) as delta_t, cost, case when cost > 0.6 then 'alignment_cost_exceeds_gamma_max' end as diagnostic from b where rn = 1"""


@query("align_candidates", _ALIGN)
def align_candidates(spark, sf):
    return X.align_candidates(_pairs(spark, sf), _CANDIDATES, gamma_max=0.6)


def _components(spark, sf):
    rows = V.cases(spark, sf)
    parts = F.array(
        *[
            F.struct(F.lit(n).alias("component"), v.alias("value"))
            for n, v in {"d_mu": F.col("p"), "d_r": F.col("discount") * 4, "d_u": F.col("tax") * 8}.items()
        ],
        F.struct(F.lit("d_extra").alias("component"), (F.col("quantity") / 50).alias("value")),
    )
    # Only every third line reports the component that has no weight.
    return rows.select("case_id", "line", F.inline(parts)).where((F.col("component") != "d_extra") | (F.col("line") == 3))


@query(
    "weighted_gamma",
    S.ctes(S.CASES)
    + """select case_id, round((p * 0.25e0 + discount * 4 * 0.35e0 + tax * 8 * 0.2e0) / (0.25e0 + 0.35e0 + 0.2e0), 10) as gamma, (line = 3)::bigint as n_missing,
    (p * 0.25e0 + discount * 4 * 0.35e0 + tax * 8 * 0.2e0) / (0.25e0 + 0.35e0 + 0.2e0) <= 0.4 and tax <= 0.05 as certified from cases""",
)
def weighted_gamma(spark, sf):
    weights = {"d_mu": 0.25, "d_r": 0.35, "d_u": 0.20}
    gamma = X.weighted_mean(_components(spark, sf), weights)
    delta = V.cases(spark, sf).select("case_id", F.col("tax").alias("delta_t"))
    out = X.certify_alignment(gamma.join(delta, "case_id"), 0.4, 0.05)
    return out.select("case_id", r10(F.col("gamma")).alias("gamma"), "n_missing", "certified")


@query("missing_weights", S.ctes(S.CASES) + "select 'd_extra' as component from cases where line = 3 limit 1")
def missing_weights(spark, sf):
    weights = spark.createDataFrame([("d_mu", 0.25), ("d_r", 0.35), ("d_u", 0.20)], "component string, weight double")
    return X.missing_weights(_components(spark, sf), weights)


@query(
    "weighted_mean_risk",
    S.ctes(S.CASES)
    + """select case_id, round((p * 0.35e0 + discount * 10 * 0.25e0 + tax * 12 * 0.2e0 + 0.3225e0 * 0.2e0) / (0.35e0 + 0.25e0 + 0.2e0 + 0.2e0), 6) as rho from cases""",
)
def weighted_mean_risk(spark, sf):
    parts = {"model_signal": F.col("p"), "block_rule": F.col("discount") * 10, "source_conflict": F.col("tax") * 12, "reduction_component": F.lit(0.3225)}
    long = V.cases(spark, sf).select("case_id", F.inline(F.array(*[F.struct(F.lit(n).alias("component"), v.alias("value")) for n, v in parts.items()])))
    from ..operators.decisions import ROUTE_RISK_WEIGHTS

    return X.weighted_mean(long, ROUTE_RISK_WEIGHTS, out="rho").select("case_id", r6(F.col("rho")).alias("rho"))


@query(
    "auto_accept_context",
    S.ctes(S.CASES)
    + """select concat_ws(';', case when p < 0.2 then 'accept' end, case when p < 0.6 then 'lower_confidence' end) as auto_actions, p < 0.6 as chi_auto, count(*)::bigint as n from cases group by 1, 2""",
)
def auto_accept_context(spark, sf):
    allowed = F.array_compact(
        F.array(
            F.lit("defer_to_human"), F.when(F.col("p") < 0.6, "lower_confidence"), F.when(F.col("p") < 0.2, "accept"),
            F.when(F.col("p") >= 0.6, "block"),
        )
    )
    rows = V.cases(spark, sf).withColumn("auto", X.auto_accept_context(allowed))
    return rows.groupBy(F.array_join("auto", ";").alias("auto_actions"), (F.size("auto") > 0).alias("chi_auto")).agg(F.count("*").alias("n"))


# --- attributions -------------------------------------------------------------------------------

@query(
    "topk_attributions",
    S.ctes(S.ATTRIBUTIONS)
    + """select case_id, 'a' as method, feature::bigint as feature, ra as rank, sign(a)::bigint as sign, round(a, 6) as value from ranked where ra <= 5
    union all select case_id, 'b', feature::bigint, rb, sign(b)::bigint, round(b, 6) from ranked where rb <= 5""",
)
def topk_attributions(spark, sf):
    """Long-form top k over both methods."""
    rows = V.attribution_cases(spark, sf)
    long = None
    for m in ("a", "b"):
        part = rows.select("case_id", F.lit(m).alias("method"), F.posexplode(f"method_{m}").alias("feature", "value"))
        long = part if long is None else long.unionByName(part)
    return A.topk_attributions(long, 5).select(
        "case_id", "method", F.col("feature").cast("long").alias("feature"), F.col("rank").cast("long").alias("rank"), "sign", r6(F.col("value")).alias("value")
    )


_CONFLICT_OUT = """select case_id, round(topk_jaccard, 6) as topk_jaccard, sign_disagreement, conflict_rank, conflict_sign, conflict_rule, chi_r, chi_r_crit,
    round(i_pre, 6) as i_pre, round(u_m, 6) as u_m, rule_action from conf"""


@query("attribution_conflict", S.CONFLICTS + _CONFLICT_OUT)
def attribution_conflict(spark, sf):
    return V.conflict_cases(spark, sf).select(
        "case_id", r6(F.col("topk_jaccard")).alias("topk_jaccard"), "sign_disagreement", "conflict_rank", "conflict_sign", "conflict_rule",
        "chi_r", "chi_r_crit", r6(F.col("i_pre")).alias("i_pre"), r6(F.col("u_m")).alias("u_m"), "rule_action",
    )


_LEVELS = "select case_id, round(rho_f0, 6) as rho_f0, round(rho_nas, 6) as rho_nas, round(rho_fml, 6) as rho_fml, action_f0, action_nas, action_fml, round(delta_m, 6) as delta_m from conf"


def _levels(spark, sf, variant):
    return V.conflict_cases(spark, sf, variant).select(
        "case_id", *[r6(F.col(c)).alias(c) for c in ("rho_f0", "rho_nas", "rho_fml")], "action_f0", "action_nas", "action_fml",
        r6(F.col("delta_m")).alias("delta_m"),
    )


@query("conflict_risk_levels", S.CONFLICTS + _LEVELS)
def conflict_risk_levels(spark, sf):
    return _levels(spark, sf, "practice")


@query("conflict_risk_levels_evidence", S.ctes(S.conflicts("evidence")) + _LEVELS)
def conflict_risk_levels_evidence(spark, sf):
    return _levels(spark, sf, "evidence")


_SHARES = """imp as (select vec_id, unnest(range(64)) as f, h from emb), w as (select vec_id, f, abs(h[f + 1]) / 8 as v from imp)"""


@query(
    "coverage_curve",
    S.ctes(S.ATTRIBUTIONS, _SHARES)
    + """, o as (select vec_id, row_number() over (partition by vec_id order by v desc, f) as k, sum(v) over (partition by vec_id order by v desc, f rows unbounded preceding) as t from w)
select vec_id, k, round(least(t, 1e0), 6) as coverage, round(greatest(1 - t, 0e0), 6) as delta from o""",
)
def coverage_curve(spark, sf):
    rows = V.embeddings(spark, sf).withColumn("imp", F.transform("h", lambda v: F.abs(v) / 8))
    out = A.coverage_curve(rows, "imp", ["vec_id"])
    return out.select("vec_id", "k", r6(F.col("coverage")).alias("coverage"), r6(F.col("delta")).alias("delta"))


@query(
    "normalise_topk",
    S.ctes(S.ATTRIBUTIONS, _SHARES)
    + """, s as (select *, sum(v) over (partition by vec_id) as total, row_number() over (partition by vec_id order by v desc, f) as k from w)
select vec_id, f::bigint as feature, round(v / total, 6) as share from s where k <= 5""",
)
def normalise_topk(spark, sf):
    rows = V.embeddings(spark, sf).withColumn("imp", F.transform("h", lambda v: F.abs(v) / 8))
    return A.normalise_topk(rows, "imp", 5, ["vec_id"])


@query(
    "route_gap",
    S.ctes(S.CASES)
    + f"""select case_id, round(greatest(abs(p - ({S.clip('discount * 10')} + {S.clip('tax * 12')}) / 2), abs(p - {S.clip('greatest(0e0, p - 0.3e0) + greatest(0e0, tax - discount)')})), 6) as gamma_route,
    round((abs(p - discount) + abs(p - tax)) / 2, 6) as gamma_rule from cases""",
)
def route_gap(spark, sf):
    alphas = F.array(F.col("discount") * 10, F.col("tax") * 12)
    attrs = F.array(F.col("p") - 0.3, F.col("tax") - F.col("discount"))
    return V.cases(spark, sf).select(
        "case_id", r6(A.route_gap(F.col("p"), alphas, attrs)).alias("gamma_route"),
        r6(A.rule_attribution_gap(F.col("p"), F.col("tax"), F.col("discount"))).alias("gamma_rule"),
    )


@query(
    "counterevidence_counts",
    """select user_id, count(*)::bigint as n_fragments, count(*) filter (where event_type <> 'error')::bigint as n_support,
    count(*) filter (where event_type = 'error')::bigint as n_counter, bool_or(event_type = 'error') as has_counter from events group by user_id""",
)
def counterevidence_counts(spark, sf):
    return A.counterevidence_counts(V.fragments(spark, sf), "user_id")


_SIGNALS = """sig as (select user_id, strftime(ts, '%Y-%m-%d') as day, value > 150 as noise, event_type = 'error' as miss,
    case when user_id % 7 = 0 and event_type = 'view' then 200 else 250 end as rate, least(value / 100, 1e0) as q from events),
sq as (select user_id, day, count(*)::bigint as n_samples, count(*) filter (where noise)::bigint as n_noise, count(*) filter (where miss)::bigint as n_missing,
    min(rate) = max(rate) and min(rate) = 250 as rate_ok, avg(q) as quality from sig group by 1, 2)"""


@query(
    "signal_quality",
    S.ctes(_SIGNALS) + "select user_id, day, n_samples, n_noise, n_missing, rate_ok, round(quality, 6) as quality, (quality < 0.58 or n_missing > 2) as limited from sq",
)
def signal_quality(spark, sf):
    out = A.signal_quality(V.signals(spark, sf), ["user_id", "day"])
    return out.withColumn("quality", r6(F.col("quality")))


_TRIAGE = S.ctes(_SIGNALS) + """, tri as (select *, case when rate_ok then 'valid' else 'adapter_rejected' end as status, n_noise > 0 or n_missing > 0 as manual_before,
    case when not rate_ok then case when n_missing > 0 then 'audit_report' else 'not_run' end when quality < 0.3 then 'manual_check' else 'accept' end as act,
    case when not rate_ok then case when n_missing > 0 then 'missing_samples' else 'rate_changed' end end as reason from sq)"""


def _triage(spark, sf):
    q = A.signal_quality(V.signals(spark, sf), ["user_id", "day"])
    ok, missing = F.col("rate_ok"), F.col("n_missing") > 0
    return q.select(
        F.when(ok, "valid").otherwise("adapter_rejected").alias("adapter_status"),
        ((F.col("n_noise") > 0) | missing).alias("manual_required_baseline"),
        F.when(~ok, F.when(missing, "audit_report").otherwise("not_run")).when(F.col("quality") < 0.3, "manual_check").otherwise("accept").alias("action"),
        F.when(~ok, F.when(missing, "missing_samples").otherwise("rate_changed")).alias("reject_reason"),
    )


@query(
    "triage_summary",
    _TRIAGE
    + """select count(*)::bigint as total_signals, count(*) filter (where status = 'valid')::bigint as valid, count(*) filter (where status <> 'valid')::bigint as rejected,
    count(*) filter (where manual_before)::bigint as manual_before, count(*) filter (where act = 'manual_check')::bigint as manual_after,
    count(*) filter (where act = 'audit_report')::bigint as audit_reports from tri""",
)
def triage_summary(spark, sf):
    return A.triage_summary(_triage(spark, sf))


@query("reject_reasons", _TRIAGE + "select reason as reject_reason, count(*)::bigint as n from tri where status <> 'valid' group by 1")
def reject_reasons(spark, sf):
    return A.reject_reasons(_triage(spark, sf))
