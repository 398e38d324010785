"""Scoring of a prediction log from probability to action."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import disagreement as D
from ..functions import gates as G
from ..functions import representation as R
from ..functions import uncertainty as U
from ..functions.fuzzy import explanation_uncertainty, risk_memberships
from ..functions.numeric import let
from ..plans.plan import GatePlan, GatePolicy
from .registry import gate_actions

# Interpretability components of the two-rule risk explanation, and the loss weight.
COMPONENTS = {"H": 0.30, "C": 0.33, "O": 0.16, "K": 0.03}
LOSS_WEIGHT = 0.10
TRACE_UNCERTAINTY = 0.01


def observe(
    df: DataFrame,
    p: str = "p",
    *,
    proba: str | None = None,
    profile: Sequence[str] | Column | None = None,
    mode: str = "audit",
    chi_r: str | None = None,
    chi_r_crit: str | None = None,
    trace_valid: str | None = None,
    diagnostic: str | None = None,
    plan: GatePlan = GatePlan(),
    policy: GatePolicy = GatePolicy(),
    registered: Sequence[str] = (),
) -> DataFrame:
    """Score and gate every row. A projection: no shuffle, works on batch and streams alike.

    With `proba` the uncertainty comes from the probability array, otherwise from p as two classes.
    With a profile the representation is chosen per row and its reduction loss enters the score. Registered gates
    see the scored row and give a column action_<name> each.
    """
    risk = F.col(p)

    def flag(name: str | None, default: bool) -> Column:
        return F.coalesce(F.col(name).cast("boolean"), F.lit(default)) if name else F.lit(default)

    blocked = flag(diagnostic, False)
    if proba:
        entropy, margin = U.entropy_uncertainty(F.col(proba)), U.margin_uncertainty(F.col(proba))
    else:
        entropy, margin = U.binary_entropy(risk), U.binary_margin(risk)
    scored = df.withColumn("u", U.blended_uncertainty(entropy, margin))
    if profile is None:
        scored = scored.withColumn("selected_class", F.lit("F0")).withColumn("reduction_loss", F.lit(0.0))
    else:
        tags = profile if isinstance(profile, Column) else F.array(*[F.lit(t) for t in profile])
        scored = scored.withColumn("selected_class", R.select_class(tags, mode))
        rep = R.build_representation(risk, tags, F.col("selected_class"))
        scored = scored.withColumn("reduction_loss", let(rep, R.reduction_loss))
    mu = risk_memberships(risk)
    u_expl = explanation_uncertainty(
        F.col("u"), F.greatest(mu["high"], mu["medium"]), F.lit(TRACE_UNCERTAINTY), plan.eta
    )
    parts = {k: F.lit(v) for k, v in COMPONENTS.items()}
    loss = D.interpretability_loss(
        **parts, U=u_expl, loss=F.col("reduction_loss"), lam=plan.lam, lam_delta=LOSS_WEIGHT
    )
    scored = scored.withColumn("interpretability", D.interpretability_index(loss))
    scored = scored.select(
        *scored.columns,
        (blocked | flag(chi_r, False)).alias("_rupture"),
        (blocked | flag(chi_r_crit, False)).alias("_critical"),
        flag(trace_valid, True).alias("_trace_ok"),
        G.application_risk(
            risk, F.col("u"), F.col("interpretability"), F.col("reduction_loss"), blocked, policy.risk_weights
        ).alias("rho"),
    )
    auto = G.chi_auto(
        risk, F.col("u"), F.col("interpretability"), F.col("_critical"), F.col("_trace_ok"),
        u_max=policy.uncertainty_max, i_min=policy.i_min,
    )
    scored = scored.withColumn("chi_auto", auto)
    args = (
        F.col("rho"), F.col("u"), F.col("interpretability"), F.col("reduction_loss"),
        F.col("_rupture"), F.col("_critical"), F.col("chi_auto"), F.col("_trace_ok"),
    )
    scored = scored.withColumn("action", G.gate_full(*args, policy))
    out = scored.select(
        *[c for c in scored.columns if not c.startswith("_") and c not in ("rho", "action")],
        F.when(F.col("_critical"), 1.0).otherwise(F.col("rho")).alias("rho"),
        "action",
        G.corrected_confidence(
            F.col("rho"), F.col("u"), F.col("interpretability"), F.col("reduction_loss"), F.col("_critical")
        ).alias("corrected_confidence"),
        G.gate_reason(F.col("action"), F.col("chi_auto"), F.col("_critical")).alias("reason"),
    )
    return out.withColumns({f"action_{name}": action for name, action in gate_actions(out, registered).items()}) if registered else out


def action_summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Action counts, coverage and mean risk per segment: one partial aggregation."""
    from ..plans.plan import ACTIONS

    n = F.count("*")
    return scored.groupBy(*by).agg(
        n.alias("n"),
        *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ACTIONS],
        (F.count_if(F.col("action") == "accept") / n).alias("coverage"),
        F.avg("rho").alias("mean_rho"),
        F.avg("interpretability").alias("mean_interpretability"),
    )


def ensemble_variance(long: DataFrame, case: str = "case_id", cls: str = "cls", value: str = "proba") -> DataFrame:
    """Spread of ensemble members per case from long rows (case, member, class, probability)."""
    per_class = long.groupBy(case, cls).agg(F.var_pop(value).alias("v"))
    mean_var = per_class.groupBy(case).agg(F.avg("v").alias("v"))
    return mean_var.select(case, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v") / 0.25)).alias("ensemble_uncertainty"))
