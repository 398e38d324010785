"""Queries over routes, comparison gates and the audit of stored decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions.numeric import r6
from ..operators import contracts as C
from ..operators import decisions as D
from ..operators.registry import register_gate
from ..session import materialised
from ..sources import views as V
from . import sql as S
from .registry import query


def routes(spark, sf):
    """Routes of the valid payloads."""
    return D.tabular_route(C.split_valid(C.parse_payloads(V.payloads(spark, sf))).valid)


@query(
    "tabular_route",
    S.ROUTED + "select case_id, uncertainty, quality, gamma, delta, rho, dominant_component, representation_class, diagnostic_id, action from routes",
)
def tabular_route(spark, sf):
    return routes(spark, sf).select(
        "case_id", "uncertainty", "quality", "gamma", "delta", "rho", "dominant_component", "representation_class", "diagnostic_id", "action"
    )


@query(
    "quality_conflict_gate",
    S.ctes(S.CASES)
    + """select reason, action, chi_r_crit, count(*)::bigint as n from (select p > 0.70 and 1 - discount * 8 < 0.45 as chi_r_crit,
    case when p > 0.70 and 1 - discount * 8 < 0.45 then 'block' when p > 0.70 then 'accept' else 'reject' end as action,
    case when p > 0.70 and 1 - discount * 8 < 0.45 then 'high_confidence_low_quality' when p > 0.70 then 'model_accept_quality_ok' else 'model_reject' end as reason from cases) group by 1, 2, 3""",
)
def quality_conflict_gate(spark, sf):
    rows = V.cases(spark, sf).select("p", (1 - F.col("discount") * 8).alias("quality"))
    return D.quality_conflict_gate(rows, "p", "quality").groupBy("reason", "action", "chi_r_crit").agg(F.count("*").alias("n"))


@query(
    "source_quality_conflict",
    S.ctes(S.CASES) + "select p >= 0.5 and 1 - discount * 8 < 0.5 and 1 - tax * 8 < 0.5 as critical, count(*)::bigint as n from cases group by 1",
)
def source_quality_conflict(spark, sf):
    crit = G.source_quality_conflict(F.col("p"), F.lit(0.5), 1 - F.col("discount") * 8, 1 - F.col("tax") * 8)
    return V.cases(spark, sf).groupBy(crit.alias("critical")).agg(F.count("*").alias("n"))


_WROUTE = S.ctes(S.CASES) + f""", w1 as (select case_id, round((p * 0.25e0 + discount * 8 * 0.35e0 + tax * 8 * 0.2e0 + y_true * 0.2e0) / 1e0, 6) as gamma,
    round((discount * 0.3e0 + tax * 0.3e0 + quantity / 100 * 0.4e0) / 1e0, 6) as delta, tax * 10 > discount * 8 and 1 - discount * 9 < 0.35 as chi_r, p, tax from cases),
w2 as (select *, chi_r and p >= 0.80 as crit, round((p * 0.35e0 + tax * 10 * 0.25e0 + chi_r::int * 0.2e0 + 0.3225e0 * 0.2e0) / 1e0, 6) as rho from w1)
select case_id, gamma, delta, rho, chi_r, crit as chi_r_crit, gamma <= 0.40 as certified, delta <= 0.35 as reduction_allowed, {S.ladder('rho', (0.25, 0.45, 0.65, 0.78), 'crit')} as action from w2"""


@query("weighted_conflict_route", _WROUTE)
def weighted_conflict_route(spark, sf):
    rows = V.cases(spark, sf).select(
        "case_id", F.col("p").alias("d_mu"), (F.col("discount") * 8).alias("d_r"), (F.col("tax") * 8).alias("d_u"), F.col("y_true").cast("double").alias("d_tau"),
        F.col("discount").alias("source_loss"), F.col("tax").alias("trace_loss"), (F.col("quantity") / 100).alias("action_loss"),
        (1 - F.col("discount") * 9).alias("segmentation_quality"), F.col("p").alias("model_match"), (F.col("discount") * 8).alias("alpha_accept"),
        (F.col("tax") * 10).alias("alpha_block"),
    )
    return D.weighted_conflict_route(rows).select(
        "case_id", "gamma", "delta", "rho", "chi_r", "chi_r_crit", "certified", "reduction_allowed", "action"
    )


@query("proxy_action", S.EVALUATION + f"select {S.proxy()} as proxy_action, {S.reference()} as reference_action, count(*)::bigint as n from ev group by 1, 2")
def proxy_action(spark, sf):
    return labelled(spark, sf).groupBy("proxy_action", "reference_action").agg(F.count("*").alias("n"))


def labelled(spark, sf):
    rows = V.evaluation_rows(spark, sf)
    args = (F.col("p"), F.col("u"), F.col("interpretability"), F.col("chi_r"), F.col("chi_r_crit"))
    wrong = F.col("y_true") != F.col("y_pred")
    return rows.withColumn("proxy_action", G.proxy_action(*args)).withColumn("reference_action", G.reference_action(*args, wrong))


_GUARDS = """, gd as (select *, abs(p - discount * 5) as attr_top, abs(tax * 6 - p) as sur_top, discount > tax as mixed,
    1 - tax * 0.7e0 as prec, discount * 1.5e0 as cov, line = 7 as emp from ev),
qq as (select quantile_cont(attr_top, 0.9e0) as qa, quantile_cont(sur_top, 0.9e0) as qs from gd)"""


def _guards_sql(access: str) -> str:
    if access == "native":
        base = "case when p >= 0.80 then 'defer_to_human' when p >= 0.35 then 'lower_confidence' else 'accept' end"
        pre = ""
    else:
        base = "case when chi_r_crit then 'block' when p >= 0.75 then 'defer_to_human' when u >= 0.45 or i < 0.65 then 'request_more_data' when p >= 0.35 then 'lower_confidence' else 'accept' end"
        pre = "when chi_r_crit then 'block' "

    def guard(cond):
        return f"case {pre}when ({cond}) and p >= 0.35 then 'defer_to_human' else {base} end"

    return S.EVALUATION + _GUARDS + f"""select case_id, {base} as threshold, {guard('attr_top >= qa')} as magnitude, {guard('mixed and sur_top >= qs')} as mixed_sign,
    {guard('emp or prec < 0.95 or cov < 0.05')} as anchor from gd, qq"""


def guard_rows(spark, sf):
    rows = V.evaluation_rows(spark, sf)
    return rows.select(
        "case_id", "p", "u", "interpretability", "chi_r", "chi_r_crit", "chi_auto", "y_true", "y_pred",
        F.abs(F.col("p") - F.col("discount") * 5).alias("attr_top"),
        F.abs(F.col("tax") * 6 - F.col("p")).alias("surrogate_top"),
        (F.col("discount") > F.col("tax")).alias("surrogate_mixed"),
        (1 - F.col("tax") * 0.7).alias("anchor_precision"),
        (F.col("discount") * 1.5).alias("anchor_coverage"),
        (F.col("line") == 7).alias("anchor_empty"),
    )


def _guards(spark, sf, access):
    return D.baseline_gates(guard_rows(spark, sf), access).select("case_id", "threshold", "magnitude", "mixed_sign", "anchor")


@query("baseline_gates_native", _guards_sql("native"))
def baseline_gates_native(spark, sf):
    return _guards(spark, sf, "native")


@query("baseline_gates_equal", _guards_sql("equal"))
def baseline_gates_equal(spark, sf):
    return _guards(spark, sf, "equal")


_RUPT = S.EVALUATION + """, ru as (select *, discount * 9 as ai, tax * 10 as si, abs(discount - tax) * 10 as ac, line <> 5 as cert,
    case when chi_r_crit then 'block' when p < 0.55 then 'accept' when p < 0.78 then 'lower_confidence' else 'defer_to_human' end as expected_action from ev),
rl as (
    select 'probability_threshold' as policy, case when p >= 0.92 then 'block' when p < 0.55 then 'accept' else 'defer_to_human' end as action, expected_action from ru union all
    select 'attribution_rule', case when ai >= 0.72 or p >= 0.94 then 'block' when p < 0.55 then 'accept' else 'defer_to_human' end, expected_action from ru union all
    select 'surrogate_rule', case when si >= 0.72 or p >= 0.94 then 'block' when p < 0.55 then 'accept' else 'defer_to_human' end, expected_action from ru union all
    select 'anchor_rule', case when ac >= 0.72 or p >= 0.94 then 'block' when p < 0.55 then 'accept' else 'defer_to_human' end, expected_action from ru union all
    select 'full_contour', case when chi_r_crit then 'block' when not trace_ok or not cert then 'request_more_data' when p < 0.55 then 'accept' when p < 0.78 then 'lower_confidence' else 'defer_to_human' end, expected_action from ru)
select policy, action, expected_action, count(*)::bigint as n from rl group by 1, 2, 3"""


@query("rupture_gates", _RUPT)
def rupture_gates(spark, sf):
    rows = V.evaluation_rows(spark, sf).select(
        "p", "chi_r_crit", "trace_valid", (F.col("discount") * 9).alias("attribution_instability"), (F.col("tax") * 10).alias("surrogate_instability"),
        (F.abs(F.col("discount") - F.col("tax")) * 10).alias("anchor_conflict"), (F.col("line") != 5).alias("certified_transition"),
    )
    return D.rupture_gates(rows).groupBy("policy", "action", "expected_action").agg(F.count("*").alias("n"))


_STRUCT = S.EVALUATION + """, g as (select * exclude (action), case when p < 0.55 then 'accept' else 'defer_to_human' end as plain from ev,
    (values ('native'), ('equal_guardrail'), ('equal_raw_structure')) m(mode),
    (values ('probability_threshold'), ('attribution_guardrail'), ('surrogate_guardrail'), ('anchor_guardrail'), ('observer')) q(policy)),
a as (select *, case when policy = 'observer' then case when chi_r_crit then 'block' when not auto or d > 0.15 or chi_r then 'request_more_data' else plain end
    when mode = 'equal_guardrail' and chi_r_crit then 'block'
    when mode = 'equal_raw_structure' and chi_r_crit and policy in ('attribution_guardrail', 'surrogate_guardrail') then 'defer_to_human'
    when mode = 'equal_raw_structure' and chi_r and policy = 'anchor_guardrail' then 'request_more_data' else plain end as action from g)
select mode, policy, round(avg((chi_r_crit = (action = 'block'))::int), 6) as agreement, count(*) filter (where chi_r_crit and action <> 'block')::bigint as missed_critical,
    round(avg(((chi_r or not auto or d > 0.15) and action = 'accept')::int), 6) as false_auto_accept from a group by 1, 2"""


@query("structure_gates", _STRUCT)
def structure_gates(spark, sf):
    rows = V.evaluation_rows(spark, sf).select("p", "chi_r", "chi_r_crit", "chi_auto", "reduction_loss")
    out = D.structure_summary(D.structure_gates(rows))
    return out.withColumn("agreement", r6(F.col("agreement"))).withColumn("false_auto_accept", r6(F.col("false_auto_accept")))


_TH = (0.25, 0.45, 0.65, 0.82)
METHODS = {
    "B0_probability_only": S.ladder("p", _TH),
    "B1_F0_basic": "action_f0",
    "B2_F0_plus_uncertainty": S.ladder(S.clip("0.55e0 * p + 0.25e0 * u_m + 0.2e0 * (1 - i_pre)"), _TH),
    "B3_sign_threshold": f"case when sign_disagreement > 0 then 'defer_to_human' else {S.ladder('p', _TH)} end",
    "B4_rank_threshold": f"case when topk_jaccard < 0.4 then 'defer_to_human' else {S.ladder('p', _TH)} end",
    "B5_rule_only": "case when rule_action = 'defer_to_human' then 'request_more_data' else rule_action end",
    "B6_equal_structure": S.ladder(S.clip("0.5e0 * p + 0.2e0 * u_m + 0.2e0 * (1 - i_pre) + 0.1e0 * delta_m"), _TH),
    "M1_NAS": "action_nas",
    "M2_F_ML": "action_fml",
}
METHODS_SQL = S.CONFLICTS + ", mm as (" + " union all ".join(f"select *, '{k}' as method, {v} as action from conf" for k, v in METHODS.items()) + ")"


@query("comparison_gates", METHODS_SQL + "select case_id, method, action from mm")
def comparison_gates(spark, sf):
    return D.comparison_gates(V.conflict_cases(spark, sf)).select("case_id", "method", "action")


CAUTIOUS_SQL = "case when chi_r_crit then 'block' when p >= 0.8e0 or u_m > 0.9e0 then 'defer_to_human' when p < 0.3e0 then 'accept' else 'lower_confidence' end"


def _cautious(c):
    return F.when(c["chi_r_crit"], "block").when((c["p"] >= 0.8) | (c["u_m"] > 0.9), "defer_to_human").when(c["p"] < 0.3, "accept").otherwise("lower_confidence")


@query(
    "registered_gate",
    METHODS_SQL + f", al as (select method, action from mm union all select 'cautious', {CAUTIOUS_SQL} from conf) select method, action, count(*)::bigint as n from al group by 1, 2",
)
def registered_gate(spark, sf):
    """A gate of one's own beside the built-in ones, counted by action."""
    register_gate("cautious", _cautious, {"chi_r_crit": "boolean", "p": "number", "u_m": "number"}, replace=True)
    return D.comparison_gates(V.conflict_cases(spark, sf), ["cautious"]).groupBy("method", "action").agg(F.count(F.lit(1)).alias("n"))


# --- audit -----------------------------------------------------------------------------------------

def decision_log(spark, sf):
    """Stored decisions made from routes, some of them altered in known ways."""
    r = routes(spark, sf)
    line = F.split("case_id", "-").getItem(1).cast("int")
    model = F.col("model_name")
    return r.select(
        "case_id",
        "uncertainty", "quality", F.col("conflict_component").alias("conflict"), F.col("interval_width").alias("interval"),
        F.when((line == 4) & (model == "model_r"), F.col("gamma") + 0.01).otherwise(F.col("gamma")).alias("gamma"),
        "delta",
        F.when((line == 5) & (model == "model_n"), F.col("rho") / 2).otherwise(F.col("rho")).alias("rho"),
        F.when((line == 2) & (model == "model_a"), "block").otherwise(F.col("action")).alias("action"),
        ((line == 1) & (model == "model_n")).alias("chi_r_crit"),
        "diagnostic_id",
        F.when(line == 3, F.array(F.lit("D_other"))).when((line == 2) & (model == "model_a"), F.array().cast("array<string>")).otherwise(F.array("diagnostic_id")).alias("diagnostics"),
        F.lit(0.8).alias("gamma_max"), F.lit(0.6).alias("delta_max"),
        F.lit("passed").alias("alignment_status"), F.when(line == 1, "passed").otherwise("blocked").alias("reduction_status"),
        F.when(model == "model_a", F.when(line != 5, "c1").otherwise("")).otherwise("c1").alias("source_commit"),
    )


_LOG = S.ROUTED + """, lg as (select case_id, uncertainty, quality, conflict, interval_w, delta, diagnostic_id,
    case when line = 4 and model_name = 'model_r' then gamma + 0.01e0 else gamma end as gamma,
    case when line = 5 and model_name = 'model_n' then rho / 2 else rho end as rho,
    case when line = 2 and model_name = 'model_a' then 'block' else action end as action, line = 1 and model_name = 'model_n' as crit,
    case when line = 3 then 1 when line = 2 and model_name = 'model_a' then 0 else 2 end as listed, line, model_name from routes)
select case_id, concat_ws(';',
    case when model_name = 'model_a' and line = 5 then 'source_commit_present' end,
    case when abs(gamma - greatest(uncertainty, quality, conflict, interval_w)) > 1e-6 then 'gamma_matches_formula' end,
    case when abs(rho - greatest(gamma, delta, quality, conflict, interval_w)) > 1e-6 then 'rho_matches_formula' end,
    case when not crit and not (case when rho < 0.35 then action = 'accept' when rho < 0.60 then action = 'lower_confidence' else action in ('audit', 'defer_to_human', 'audit_report') end) then 'action_matches_risk_zone' end,
    case when crit and action <> 'block' then 'critical_not_blocked' end,
    case when not crit and action = 'block' then 'block_without_critical' end,
    case when action = 'block' and listed = 0 then 'block_without_diagnostics' end,
    case when gamma > 0.8e0 then 'alignment_passed_over_gamma_max' end,
    case when line = 1 and delta > 0.6e0 then 'reduction_passed_over_delta_max' end,
    case when listed <> 2 then 'diagnostic_id_not_listed' end) as errors from lg"""


@query("audit_decisions", _LOG)
def audit_decisions(spark, sf):
    return D.audit_decisions(decision_log(spark, sf)).select("case_id", F.array_join("errors", ";").alias("errors"))


_FP = """sha256('{"action":"' || action || '","case_id":"' || case_id || '","dominant_component":"' || dominant_component || '"}')"""


@query("decision_fingerprint", S.ROUTED + f"select case_id, {_FP} as fingerprint from routes")
def decision_fingerprint(spark, sf):
    return D.decision_fingerprint(routes(spark, sf), ["case_id", "action", "dominant_component"]).select("case_id", "fingerprint")


@query(
    "tamper_check",
    S.ROUTED
    + """select case when line = 4 then 'tampered' when line = 5 then 'unknown' else 'ok' end as status, count(*)::bigint as n from routes group by 1""",
)
def tamper_check(spark, sf):
    cols = ["case_id", "action", "dominant_component"]
    now = materialised(routes(spark, sf).select(*cols))
    line = F.split("case_id", "-").getItem(1).cast("int")
    stored = D.decision_fingerprint(now.withColumn("action", F.when(line == 4, "accepted").otherwise(F.col("action"))), cols)
    return D.tamper_check(now, stored.where(line != 5), "case_id", cols).groupBy("status").agg(F.count("*").alias("n"))


_TWO = "format('{{:.2f}}', {x})"


def _f2(x: str) -> str:
    return f"printf('%.2f', {x})"


def _band(x: str, name: str) -> str:
    return f"'{name} ' || {_f2(x)} || ' is ' || case when {x} < 0.15 then 'small' when {x} < 0.45 then 'moderate' else 'high' end || '.'"


@query(
    "decision_text",
    S.ROUTED
    + f"""select case_id, concat_ws(' ', case action
    when 'accept' then 'Risk ' || {_f2('rho')} || ' is below the accept limit 0.35; use the result as usual.'
    when 'lower_confidence' then 'Risk ' || {_f2('rho')} || ' is between the accept limit 0.35 and the audit limit 0.60; use the result with less confidence.'
    when 'audit' then 'Risk ' || {_f2('rho')} || ' is in the audit zone; check before use.'
    when 'defer_to_human' then 'The automatic decision is not reliable enough; pass it to a person.' end,
    {_band('gamma', 'Uncertainty')}, {_band('delta', 'Loss of detail')}) as text from (select case_id, action, round(rho, 2) as rho, round(gamma, 2) as gamma, round(delta, 2) as delta from routes)""",
)
def decision_text(spark, sf):
    # Values are rounded to the two places shown, so that text and band agree.
    r = routes(spark, sf)
    text = D.decision_text(F.col("action"), F.round("rho", 2), F.round("gamma", 2), F.round("delta", 2))
    return r.select("case_id", text.alias("text"))
