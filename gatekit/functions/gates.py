"""Risk scores and decision ladders as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.plan import RISK_TERMS, GatePolicy, risk_shares
from .numeric import clip01


def weighted_terms(values: Mapping[str, Column], weights: Mapping[str, Column | float]) -> Column:
    """Sum of weight times value, added in the fixed term order."""
    total = None
    for name in RISK_TERMS:
        part = weights[name] * values[name]
        total = part if total is None else total + part
    return total


def application_risk(p, u, interpretability, loss, diagnostic, weights: Mapping[str, float] | None = None) -> Column:
    """Risk score from the five clipped terms and normalised weights."""
    return clip01(
        weighted_terms(
            {
                "predicted_risk": clip01(p),
                "uncertainty": clip01(u),
                "interpretability_gap": clip01(1.0 - clip01(interpretability)),
                "reduction_loss": clip01(loss),
                "diagnostic": diagnostic.cast("double"),
            },
            risk_shares(weights),
        )
    )


def config_risk(p, u, interpretability, loss, diagnostic, weights: Mapping[str, Column]) -> Column:
    """The same score with already normalised weights that are columns."""
    return clip01(
        weighted_terms(
            {
                "predicted_risk": p,
                "uncertainty": u,
                "interpretability_gap": 1.0 - interpretability,
                "reduction_loss": loss,
                "diagnostic": diagnostic.cast("double"),
            },
            weights,
        )
    )


def aggregate_risk(components: Mapping[str, Column], mode: str = "max", weights: Mapping[str, float] | None = None) -> Column:
    floored = [F.greatest(F.lit(0.0), c) for c in components.values()]
    if not floored:
        return F.lit(0.0)
    if mode == "max":
        return F.greatest(*floored) if len(floored) > 1 else floored[0]
    if mode == "weighted_sum":
        if weights is None:
            raise ValueError("weighted_sum needs weights")
        return sum((weights[k] * c for k, c in components.items()), F.lit(0.0))
    if mode == "probabilistic_or":
        keep = F.lit(1.0)
        for c in floored:
            keep = keep * (1.0 - c)
        return 1.0 - keep
    raise ValueError(f"unknown mode {mode!r}")


def zone_ladder(rho: Column, thetas: Sequence, critical: Column | None = None) -> Column:
    """Four thresholds, five actions; a critical case is blocked first."""
    t1, t2, t3, t4 = thetas
    ladder = F.when(critical, "block").when(rho < t1, "accept") if critical is not None else F.when(rho < t1, "accept")
    return (
        ladder.when(rho < t2, "lower_confidence")
        .when(rho < t3, "request_more_data")
        .when(rho < t4, "defer_to_human")
        .otherwise("block")
    )


CONFLICT_THETAS = (0.25, 0.45, 0.65, 0.82)
WEIGHTED_ROUTE_THETAS = (0.25, 0.45, 0.65, 0.78)


def zone_three(rho: Column) -> Column:
    return F.when(rho < 0.35, "accept").when(rho < 0.60, "lower_confidence").otherwise("audit")


def zone_plan(rho: Column, accept: float = 0.35, warning: float = 0.60, audit: float = 0.75) -> Column:
    return F.when(rho < accept, "accept").when(rho < warning, "lower_confidence").when(rho < audit, "audit").otherwise("block")


def gate_simple(rho, u, p, blocked: Column, policy: GatePolicy = GatePolicy(), theta_high: Column | None = None) -> Column:
    """Gate without rupture flags: action only."""
    high = policy.theta_high if theta_high is None else theta_high
    stop = blocked if policy.block_on_diagnostic else F.lit(False)
    return (
        F.when(stop, "block")
        .when(rho >= high, "defer_to_human")
        .when((rho >= policy.theta_mid) & (u >= policy.uncertainty_max), "request_more_data")
        .when(rho >= policy.theta_mid, "lower_confidence")
        .when((u >= policy.uncertainty_max) & (p >= policy.theta_mid), "lower_confidence")
        .otherwise("accept")
    )


def full_ladder(rho, u, interpretability, loss, rupture, critical, auto, trace_ok, *, thetas, i_min, delta_max, u_max) -> Column:
    """Gate with rupture and context flags. Thresholds may be numbers or columns."""
    t1, t2, t3, t4 = thetas
    weak = (u >= u_max) | (loss > delta_max) | (interpretability < i_min) | ~trace_ok
    return (
        F.when(critical, "block")
        .when(~auto & (rho >= t3), "defer_to_human")
        .when(~auto, "request_more_data")
        .when((rho < t1) & ~rupture & ~weak, "accept")
        .when((rho < t2) & ~rupture, "lower_confidence")
        .when(weak, "request_more_data")
        .when(rho < t4, "defer_to_human")
        .otherwise("block")
    )


def gate_full(rho, u, interpretability, loss, rupture, critical, auto, trace_ok, policy: GatePolicy = GatePolicy()) -> Column:
    return full_ladder(
        rho, u, interpretability, loss, rupture, critical, auto, trace_ok,
        thetas=(policy.theta_1, policy.theta_2, policy.theta_3, policy.theta_4),
        i_min=policy.i_min, delta_max=policy.delta_max, u_max=policy.uncertainty_max,
    )


def corrected_confidence(rho, u, interpretability, loss, critical: Column) -> Column:
    kept = clip01((1.0 - u) * (1.0 - rho) * interpretability * (1.0 - loss))
    return F.when(critical, 0.0).otherwise(kept)


# Reasons are keyed by what the ladder decided and why.
def gate_reason(action: Column, auto: Column, critical: Column) -> Column:
    return (
        F.when(critical, "critical rupture or diagnostic stops the automatic decision")
        .when(~auto & (action == "defer_to_human"), "context rules out auto-accept and the risk is elevated")
        .when(~auto, "context rules out auto-accept")
        .when(action == "accept", "every condition for automatic accept holds")
        .when(action == "lower_confidence", "low risk, conditions for full accept not met")
        .when(action == "request_more_data", "confidence, interpretability, detail or trace is too weak")
        .when(action == "defer_to_human", "risk calls for human review")
        .otherwise("risk is too high to continue")
    )


def chi_auto(p, u, interpretability, critical, trace_ok, *, u_max=0.45, i_min=0.65) -> Column:
    return (p < 0.35) & (u < u_max) & (interpretability >= i_min) & ~critical & trace_ok


def trace_valid(trace: Column) -> Column:
    ok = F.lit(True)
    for name in ("id", "version", "timestamp", "source", "checksum"):
        ok = ok & (F.coalesce(trace[name], F.lit("")) != "")
    return ok


# --- reference labels and baseline gates --------------------------------------

def proxy_action(p, u, interpretability, rupture, critical) -> Column:
    return (
        F.when(critical, "block")
        .when((rupture & (p >= 0.80)) | (p >= 0.75), "defer_to_human")
        .when((u >= 0.45) | (interpretability < 0.65), "request_more_data")
        .when(p >= 0.35, "lower_confidence")
        .otherwise("accept")
    )


def reference_action(p, u, interpretability, rupture, critical, wrong: Column) -> Column:
    """Label that also uses whether the prediction was wrong."""
    return (
        F.when(critical, "block")
        .when(wrong & (p >= 0.65), "defer_to_human")
        .when(rupture | (u >= 0.45) | (interpretability < 0.65), "request_more_data")
        .when(p >= 0.75, "defer_to_human")
        .when(p >= 0.35, "lower_confidence")
        .otherwise("accept")
    )


def threshold_native(p) -> Column:
    return F.when(p >= 0.80, "defer_to_human").when(p >= 0.35, "lower_confidence").otherwise("accept")


def threshold_flagged(p, u, interpretability, critical) -> Column:
    return (
        F.when(critical, "block")
        .when(p >= 0.75, "defer_to_human")
        .when((u >= 0.45) | (interpretability < 0.65), "request_more_data")
        .when(p >= 0.35, "lower_confidence")
        .otherwise("accept")
    )


def guarded(warning: Column, p, fallback: Column, critical: Column | None = None) -> Column:
    """Defer when a guard warns and the risk is not low; block critical cases when the guard sees them."""
    first = F.when(critical, "block") if critical is not None else None
    deferred = (warning & (p >= 0.35), "defer_to_human")
    return (first.when(*deferred) if first is not None else F.when(*deferred)).otherwise(fallback)


def quality_conflict(score, quality, score_min=0.70, quality_min=0.45) -> Column:
    """Critical when a confident score rests on low quality."""
    return (score > score_min) & (quality < quality_min)


def source_quality_conflict(match, alpha_accept, quality_a, quality_b) -> Column:
    return (match >= alpha_accept) & (quality_a < 0.5) & (quality_b < 0.5)
