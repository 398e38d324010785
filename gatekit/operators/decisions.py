"""Routes from payloads to actions, comparison gates, audit and texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions.numeric import array_sum, clip01, config_array
from .attributions import conflict_rho
from .quantiles import exact_quantiles, unpivot
from .registry import gate_actions


# --- tabular route -----------------------------------------------------------------

def _diagnostic_and_action(task, rho, gamma, delta, quality, conflict, interval) -> Column:
    soft = F.when(rho < 0.60, "lower_confidence").otherwise("audit")

    def pair(diagnostic, action) -> Column:
        d = diagnostic if isinstance(diagnostic, Column) else F.lit(diagnostic)
        a = action if isinstance(action, Column) else F.lit(action)
        return F.struct(d.alias("diagnostic_id"), a.alias("action"))

    image = task == "image_like_classification"
    return (
        F.when(rho < 0.35, pair("D_external_tabular_ok", "accept"))
        .when(
            (task == "signal_quality") & (quality >= 0.55),
            pair(F.when(quality >= 0.70, "D_signal_missing_fragments").otherwise("D_signal_noise_limit"), "defer_to_human"),
        )
        .when(image & (quality >= 0.55), pair("D_image_quality_limit", "audit"))
        .when(conflict >= 0.55, pair("D_rule_attribution_conflict", "audit"))
        .when(
            task == "tabular_regression",
            pair(
                F.when(interval >= delta, "D_external_regression_uncertainty").otherwise(
                    "D_external_regression_explanation_loss"
                ),
                soft,
            ),
        )
        .when(
            image,
            pair(F.when(delta >= gamma, "D_image_explanation_reduction").otherwise("D_external_image_uncertainty"), soft),
        )
        .when(quality >= 0.35, pair("D_external_tabular_quality_limit", soft))
        .when((delta >= gamma) & (delta >= 0.45), pair("D_external_tabular_reduction_loss", soft))
        .otherwise(pair("D_external_tabular_uncertainty", soft))
    )


def tabular_route(payloads: DataFrame) -> DataFrame:
    """Components, dominant component, representation, diagnostic and action of flattened payloads.

    Values are rounded before thresholds are tested. Narrow: one projection chain.
    """
    r = payloads.withColumn("uncertainty", F.round(1.0 - F.col("class_probability"), 6)).withColumn(
        "quality", F.round(F.greatest("missing_rate", "feature_range_violation", "signal_noise", "image_noise"), 6)
    )
    total = array_sum(F.map_values("feature_importance"))
    r = r.withColumn("gamma", F.greatest("uncertainty", "quality", "conflict_component", "interval_width")).withColumn(
        "delta", F.round(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), total)), 6)
    )
    r = r.withColumn("rho", F.greatest("gamma", "delta", "quality", "conflict_component", "interval_width"))
    # The first component that reaches rho, in fixed order.
    dominant = (
        F.when(F.col("gamma") == F.col("rho"), "gamma")
        .when(F.col("delta") == F.col("rho"), "delta")
        .when(F.col("quality") == F.col("rho"), "quality")
        .when(F.col("conflict_component") == F.col("rho"), "conflict")
        .otherwise("interval")
    )
    rep = (
        F.when(F.coalesce(F.col("representation_class"), F.lit("")) != "", F.col("representation_class"))
        .when(F.col("interval_width") > 0, "F_int")
        .when((F.col("conflict_component") > 0) | (F.col("quality") >= 0.55), "NAS")
        .when(F.col("task_type").isin("signal_quality", "image_like_classification"), "F_ML")
        .otherwise("F0")
    )
    choice = _diagnostic_and_action(
        F.col("task_type"), F.col("rho"), F.col("gamma"), F.col("delta"), F.col("quality"),
        F.col("conflict_component"), F.col("interval_width"),
    )
    return (
        r.withColumn("dominant_component", dominant)
        .withColumn("representation_class", rep)
        .withColumn("_choice", choice)
        .select(*r.columns[: r.columns.index("representation_class")], "representation_class",
                *r.columns[r.columns.index("representation_class") + 1:], "dominant_component", "_choice.*")
    )


def quality_conflict_gate(df: DataFrame, score: str, quality: str) -> DataFrame:
    """Block confident scores that rest on low quality; otherwise accept or reject by score."""
    critical = G.quality_conflict(F.col(score), F.col(quality))
    base = F.when(F.col(score) > 0.70, "accept").otherwise("reject")
    return df.select(
        "*",
        critical.alias("chi_r_crit"),
        base.alias("baseline_action"),
        F.when(critical, "block").otherwise(base).alias("action"),
        F.when(critical, "high_confidence_low_quality")
        .when(F.col(score) > 0.70, "model_accept_quality_ok")
        .otherwise("model_reject")
        .alias("reason"),
    )


# Weights and limits of the weighted conflict route.
ROUTE_GAMMA_WEIGHTS = {"d_mu": 0.25, "d_r": 0.35, "d_u": 0.20, "d_tau": 0.20}
ROUTE_DELTA_WEIGHTS = {"source_loss": 0.30, "trace_loss": 0.30, "action_loss": 0.40}
ROUTE_RISK_WEIGHTS = {"model_signal": 0.35, "block_rule": 0.25, "source_conflict": 0.20, "reduction_component": 0.20}
REDUCTION_COMPONENT = 0.3225


def _weighted(weights: Mapping[str, float], values: Mapping[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + values[name] * F.lit(w)
    return F.round(total / F.lit(sum(weights.values())), 6)


def weighted_conflict_route(df: DataFrame, gamma_max: float = 0.40, delta_max: float = 0.35, delta_t: float = 0.08) -> DataFrame:
    """Alignment, reduction and risk of a case with source quality, on the four-zone ladder.

    Needs the component columns of the weight tables above and segmentation_quality,
    model_match, alpha_accept, alpha_block.
    """
    rupture = (F.col("alpha_block") > F.col("alpha_accept")) & (F.col("segmentation_quality") < 0.35)
    r = df.select(
        "*",
        _weighted(ROUTE_GAMMA_WEIGHTS, {k: F.col(k) for k in ROUTE_GAMMA_WEIGHTS}).alias("gamma"),
        _weighted(ROUTE_DELTA_WEIGHTS, {k: F.col(k) for k in ROUTE_DELTA_WEIGHTS}).alias("delta"),
        rupture.alias("chi_r"),
        (rupture & (F.col("model_match") >= 0.80)).alias("chi_r_crit"),
    )
    rho = _weighted(
        ROUTE_RISK_WEIGHTS,
        {
            "model_signal": F.col("model_match"),
            "block_rule": F.col("alpha_block"),
            "source_conflict": F.col("chi_r").cast("double"),
            "reduction_component": F.lit(REDUCTION_COMPONENT),
        },
    )
    r = r.withColumn("rho", rho)
    return r.select(
        "*",
        ((F.col("gamma") <= gamma_max) & F.lit(delta_t <= delta_max)).alias("certified"),
        (F.col("delta") <= delta_max).alias("reduction_allowed"),
        G.zone_ladder(F.col("rho"), G.WEIGHTED_ROUTE_THETAS, F.col("chi_r_crit")).alias("action"),
    )


# --- comparison gates --------------------------------------------------------------

def baseline_gates(df: DataFrame, access: str = "native", q: float = 0.90) -> DataFrame:
    """Threshold, magnitude, mixed-sign and anchor gates side by side.

    Needs p, u, interpretability, chi_r_crit, attr_top, surrogate_top, surrogate_mixed,
    anchor_precision, anchor_coverage and anchor_empty. The two cut values are exact quantiles of
    the whole table, found together and read by one scalar subquery.
    """
    p, crit = F.col("p"), F.col("chi_r_crit")
    both = exact_quantiles(unpivot(df, ["attr_top", "surrogate_top"]), "value", {"q": q}, keys=["column"], few_keys=True)
    cut = both.agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("q"))).alias(c) for c in ("attr_top", "surrogate_top")]))
    if access == "native":
        fallback, seen = G.threshold_native(p), None
    elif access == "equal":
        fallback, seen = G.threshold_flagged(p, F.col("u"), F.col("interpretability"), crit), crit
    else:
        raise ValueError(f"unknown access {access!r}")
    weak = F.col("anchor_empty") | (F.col("anchor_precision") < 0.95) | (F.col("anchor_coverage") < 0.05)
    with_cuts = df.withColumn("_cut", cut.scalar())
    mixed = F.col("surrogate_mixed") & (F.col("surrogate_top") >= F.col("_cut.surrogate_top"))
    return with_cuts.select(
        *df.columns,
        fallback.alias("threshold"),
        G.guarded(F.col("attr_top") >= F.col("_cut.attr_top"), p, fallback, seen).alias("magnitude"),
        G.guarded(mixed, p, fallback, seen).alias("mixed_sign"),
        G.guarded(weak, p, fallback, seen).alias("anchor"),
    )


RUPTURE_POLICIES = ("probability_threshold", "attribution_rule", "surrogate_rule", "anchor_rule", "full_contour")


def rupture_gates(df: DataFrame) -> DataFrame:
    """Five policies on critical ruptures, long form, with the reference action."""
    p, crit = F.col("p"), F.col("chi_r_crit")

    def instability(name: str) -> Column:
        return (
            F.when((F.col(name) >= 0.72) | (p >= 0.94), "block").when(p < 0.55, "accept").otherwise("defer_to_human")
        )

    graded = F.when(p < 0.55, "accept").when(p < 0.78, "lower_confidence").otherwise("defer_to_human")
    actions = {
        "probability_threshold": F.when(p >= 0.92, "block").when(p < 0.55, "accept").otherwise("defer_to_human"),
        "attribution_rule": instability("attribution_instability"),
        "surrogate_rule": instability("surrogate_instability"),
        "anchor_rule": instability("anchor_conflict"),
        "full_contour": F.when(crit, "block")
        .when(~F.col("trace_valid") | ~F.col("certified_transition"), "request_more_data")
        .otherwise(graded),
    }
    return long_actions(df.withColumn("expected_action", F.when(crit, "block").otherwise(graded)), actions)


def long_actions(df: DataFrame, actions: Mapping[str, Column], name: str = "policy") -> DataFrame:
    """One row per case and policy: a projection and an explode, no join."""
    pairs = F.array(*[F.struct(F.lit(k).alias(name), v.alias("action")) for k, v in actions.items()])
    return df.select("*", F.inline(pairs))


STRUCTURE_POLICIES = ("probability_threshold", "attribution_guardrail", "surrogate_guardrail", "anchor_guardrail", "observer")
STRUCTURE_MODES = ("native", "equal_guardrail", "equal_raw_structure")


def structure_gates(df: DataFrame) -> DataFrame:
    """Five policies under three levels of access to the raw structure."""
    grid = config_array([{"policy": p, "mode": m} for m in STRUCTURE_MODES for p in STRUCTURE_POLICIES])
    rows = df.select("*", F.inline(grid))
    policy, mode, crit, rupture = F.col("policy"), F.col("mode"), F.col("chi_r_crit"), F.col("chi_r")
    plain = F.when(F.col("p") < 0.55, "accept").otherwise("defer_to_human")
    observer = policy == "observer"
    withheld = ~F.col("chi_auto") | (F.col("reduction_loss") > 0.15) | rupture
    action = (
        F.when(observer & crit, "block")
        .when(observer & withheld, "request_more_data")
        .when(observer, plain)
        .when((mode == "equal_guardrail") & crit, "block")
        .when(
            (mode == "equal_raw_structure") & crit & policy.isin("attribution_guardrail", "surrogate_guardrail"),
            "defer_to_human",
        )
        .when((mode == "equal_raw_structure") & rupture & (policy == "anchor_guardrail"), "request_more_data")
        .otherwise(plain)
    )
    return rows.withColumn("action", action)


def structure_summary(gated: DataFrame) -> DataFrame:
    crit, block = F.col("chi_r_crit"), F.col("action") == "block"
    unsafe = F.col("chi_r") | ~F.col("chi_auto") | (F.col("reduction_loss") > 0.15)
    return gated.groupBy("mode", "policy").agg(
        F.avg((crit == block).cast("double")).alias("agreement"),
        F.count_if(crit & ~block).alias("missed_critical"),
        F.avg((unsafe & (F.col("action") == "accept")).cast("double")).alias("false_auto_accept"),
    )


def comparison_gates(df: DataFrame, registered: Sequence[str] = ()) -> DataFrame:
    """Nine gates on conflict cases, and registered ones by name, long form with the gate name in method."""
    p, u, gap = F.col("p"), F.col("u_m"), 1.0 - F.col("i_pre")

    def ladder(rho: Column) -> Column:
        return G.zone_ladder(rho, G.CONFLICT_THETAS)

    actions = {
        "B0_probability_only": ladder(p),
        "B1_F0_basic": F.col("action_f0"),
        "B2_F0_plus_uncertainty": ladder(clip01(0.55 * p + 0.25 * u + 0.20 * gap)),
        "B3_sign_threshold": F.when(F.col("sign_disagreement") > 0, "defer_to_human").otherwise(ladder(p)),
        "B4_rank_threshold": F.when(F.col("topk_jaccard") < 0.4, "defer_to_human").otherwise(ladder(p)),
        "B5_rule_only": F.when(F.col("rule_action") == "defer_to_human", "request_more_data").otherwise(F.col("rule_action")),
        "B6_equal_structure": ladder(clip01(0.50 * p + 0.20 * u + 0.20 * gap + 0.10 * F.col("delta_m"))),
        "M1_NAS": F.col("action_nas"),
        "M2_F_ML": F.col("action_fml"),
    }
    return long_actions(df, actions | gate_actions(df, registered), "method")


# --- audit ----------------------------------------------------------------------------

TOLERANCE = 1e-6


def audit_decisions(log: DataFrame) -> DataFrame:
    """Recompute a stored decision and list what does not fit, as an array of codes.

    Log columns: uncertainty, quality, conflict, interval, gamma, delta, rho, action, chi_r_crit,
    diagnostic_id, diagnostics array<string>, gamma_max, delta_max, alignment_status,
    reduction_status, source_commit.
    """
    c = {n: F.col(n) for n in log.columns}

    def off(stored: Column, expected: Column) -> Column:
        return F.abs(stored - expected) > TOLERANCE

    gamma = F.greatest(c["uncertainty"], c["quality"], c["conflict"], c["interval"])
    rho = F.greatest(c["gamma"], c["delta"], c["quality"], c["conflict"], c["interval"])
    in_zone = (
        F.when(c["rho"] < 0.35, c["action"] == "accept")
        .when(c["rho"] < 0.60, c["action"] == "lower_confidence")
        .otherwise(c["action"].isin("audit", "defer_to_human", "audit_report"))
    )
    empty = F.size(c["diagnostics"]) == 0
    checks = [
        ("source_commit_present", F.coalesce(c["source_commit"], F.lit("")) == ""),
        ("diagnostic_present", F.coalesce(c["diagnostic_id"], F.lit("")) == ""),
        ("gamma_matches_formula", off(c["gamma"], gamma)),
        ("rho_matches_formula", off(c["rho"], rho)),
        ("action_matches_risk_zone", ~in_zone & ~c["chi_r_crit"]),
        ("critical_not_blocked", c["chi_r_crit"] & (c["action"] != "block")),
        ("block_without_critical", ~c["chi_r_crit"] & (c["action"] == "block")),
        ("block_without_diagnostics", (c["action"] == "block") & empty),
        ("alignment_passed_over_gamma_max", (c["alignment_status"] == "passed") & (c["gamma"] > c["gamma_max"])),
        ("reduction_passed_over_delta_max", (c["reduction_status"] == "passed") & (c["delta"] > c["delta_max"])),
        (
            "diagnostic_id_not_listed",
            (F.coalesce(c["diagnostic_id"], F.lit("")) != "") & ~F.array_contains(c["diagnostics"], c["diagnostic_id"]),
        ),
    ]
    codes = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in checks]))
    return log.withColumn("errors", codes).withColumn("verdict", F.when(F.size("errors") == 0, "passed").otherwise("failed"))


def fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of a row as canonical JSON: fields sorted by name, nulls left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def decision_fingerprint(df: DataFrame, columns: Sequence[str], out: str = "fingerprint") -> DataFrame:
    return df.withColumn(out, fingerprint(columns))


def tamper_check(current: DataFrame, stored: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Compare fingerprints with stored ones by key; rows on one side only are reported too."""
    now = current.select(key, fingerprint(columns).alias("now"))
    joined = now.join(stored.select(key, F.col("fingerprint").alias("then")), key, "full_outer")
    status = (
        F.when(F.col("now").isNull(), "missing")
        .when(F.col("then").isNull(), "unknown")
        .when(F.col("now") == F.col("then"), "ok")
        .otherwise("tampered")
    )
    return joined.select(key, status.alias("status"))


# --- texts ------------------------------------------------------------------------------

def _two(c: Column) -> Column:
    return F.format_string("%.2f", c)


def decision_text(action: Column, rho: Column, gamma: Column, delta: Column) -> Column:
    """One short English paragraph per decision: the action, then gamma, then delta."""
    by_action = (
        F.when(action == "accept", F.concat(F.lit("Risk "), _two(rho), F.lit(" is below the accept limit 0.35; use the result as usual.")))
        .when(
            action == "lower_confidence",
            F.concat(F.lit("Risk "), _two(rho), F.lit(" is between the accept limit 0.35 and the audit limit 0.60; use the result with less confidence.")),
        )
        .when(action == "audit", F.concat(F.lit("Risk "), _two(rho), F.lit(" is in the audit zone; check before use.")))
        .when(action == "defer_to_human", F.lit("The automatic decision is not reliable enough; pass it to a person."))
        .when(
            action == "block",
            F.concat(F.lit("Risk "), _two(rho), F.lit(" reached the critical limit 0.75 or a critical flag is set; stop here.")),
        )
        .otherwise(F.concat(F.lit("Action "), action, F.lit(" at risk "), _two(rho), F.lit(".")))
    )

    def band(value: Column, name: str) -> Column:
        size = F.when(value < 0.15, "small").when(value < 0.45, "moderate").otherwise("high")
        return F.concat(F.lit(f"{name} "), _two(value), F.lit(" is "), size, F.lit("."))

    return F.concat_ws(" ", by_action, band(gamma, "Uncertainty"), band(delta, "Loss of detail"))
