"""Ablations, sensitivity sweeps and calibration over tables of cases.

A handful of configs meets the cases by exploding a literal array inside the row; thousands of them are
scored as a matrix in the tasks. Counters are combined there; a shuffle carries one row per config and task,
never the product.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions.numeric import clip01, config_array, double_array, hash_uniform
from ..plans.plan import RISK_TERMS, RISK_WEIGHTS, GatePolicy, risk_shares
from ..session import materialised
from .attributions import AUTO_HIGH, AUTO_LOW, conflict_rho
from .decisions import long_actions
from .metrics import is_auto, objective, objective_metrics, policy_metrics, share

EVAL_WEIGHTS = {
    "predicted_risk": 0.40, "uncertainty": 0.20, "interpretability_gap": 0.15, "reduction_loss": 0.10, "diagnostic": 0.15,
}


# --- ablations --------------------------------------------------------------------------

ABLATION_MODES = ("full", "no_trace", "no_delta", "no_critical_rupture", "f0_only", "no_topos", "probability_threshold")


def ablation_modes(cases: DataFrame) -> DataFrame:
    """Metrics of the gate with one ingredient removed at a time.

    Cases need p, u, interpretability, reduction_loss, chi_r, chi_r_crit and chi_auto.
    """
    rows = cases.select("*", F.explode(F.array(*[F.lit(m) for m in ABLATION_MODES])).alias("mode"))
    mode = F.col("mode")
    rows = rows.select(
        "p", "u", "interpretability", "chi_auto", "mode",
        ((mode != "no_trace") & F.col("chi_r")).alias("chi_r"),
        ((mode != "no_trace") & F.col("chi_r_crit")).alias("chi_r_crit"),
        F.when(mode == "no_delta", 0.0)
        .when(mode == "f0_only", F.greatest(F.lit(0.25), F.col("reduction_loss")))
        .otherwise(F.col("reduction_loss"))
        .alias("reduction_loss"),
    )
    p, u, i = F.col("p"), F.col("u"), F.col("interpretability")
    rho = G.config_risk(p, u, i, F.col("reduction_loss"), F.col("chi_r"), EVAL_WEIGHTS)
    rows = rows.withColumn("rho", rho)
    r = F.col("rho")
    # What the ladder would do, then the three corrections in order.
    withheld = F.col("chi_r") | ((mode != "no_topos") & ~F.col("chi_auto"))
    gate = (
        F.when((mode != "no_critical_rupture") & F.col("chi_r_crit"), "block")
        .when((r < 0.10) & (u < 0.45) & withheld, "request_more_data")
        .when((r < 0.10) & (u < 0.45), "accept")
        .when((r < 0.25) & (mode != "no_topos") & ~F.col("chi_auto"), "request_more_data")
        .when(r < 0.25, "lower_confidence")
        .when(r < 0.50, "request_more_data")
        .otherwise("defer_to_human")
    )
    gated = rows.withColumn("action", F.when(mode == "probability_threshold", G.threshold_native(p)).otherwise(gate))
    labelled = gated.withColumn("proxy_action", G.proxy_action(p, u, i, F.col("chi_r"), F.col("chi_r_crit")))
    metrics = policy_metrics(labelled, by=("mode",), expected={"agreement_proxy": "proxy_action"})
    losses = labelled.groupBy("mode").agg(F.avg("reduction_loss").alias("mean_reduction_loss"))
    return metrics.join(losses, "mode")


ROUTE_VARIANTS = (
    "full", "without_gamma", "without_delta", "without_quality_component",
    "without_representation_selection", "without_verifier",
)


def _route_values() -> dict[str, Column]:
    gamma, delta, rho = F.col("gamma"), F.col("delta"), F.col("rho")
    values = dict.fromkeys(ROUTE_VARIANTS, rho)
    values.update(without_gamma=delta, without_delta=gamma, without_quality_component=F.greatest(gamma, delta))
    return values


def route_ablation(routes: DataFrame) -> DataFrame:
    """Changed actions and mean risk when one part of the route is dropped."""
    pairs = F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("value")) for k, v in _route_values().items()])
    rows = routes.select(F.col("action").alias("base_action"), F.inline(pairs))
    return rows.groupBy("variant").agg(
        F.count_if(G.zone_three(F.col("value")) != F.col("base_action")).alias("changed_actions"),
        F.round(F.avg(F.round("value", 6)), 6).alias("mean_rho"),
    )


def route_ablation_wide(routes: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: the action without gamma, delta and quality, and whether any differs."""
    values = _route_values()
    names = ("without_gamma", "without_delta", "without_quality_component")
    wide = routes.select(case, F.col("action").alias("base_action"), *[G.zone_three(values[n]).alias(f"action_{n}") for n in names])
    changed = F.lit(False)
    for n in names:
        changed = changed | (F.col(f"action_{n}") != F.col("base_action"))
    return wide.withColumn("action_changed", changed)


CONFLICT_VARIANTS: Mapping[str, tuple[str, ...]] = {
    "without_rank_conflict": ("conflict_sign", "conflict_rule"),
    "without_sign_conflict": ("conflict_rank", "conflict_rule"),
    "without_rule_conflict": ("conflict_rank", "conflict_sign"),
    "without_source_labels": ("conflict_rank",),
    "without_delta_reduction": ("conflict_rank", "conflict_sign", "conflict_rule"),
    "without_critical_flag": ("conflict_rank", "conflict_sign", "conflict_rule"),
}


def conflict_ablation(cases: DataFrame) -> DataFrame:
    """Objective and effect of dropping each source of conflict."""
    actions = {"full": F.col("action_nas")}
    for name, sources in CONFLICT_VARIANTS.items():
        chi = F.lit(False)
        for s in sources:
            chi = chi | F.col(s)
        crit = F.lit(False) if name == "without_critical_flag" else F.col("chi_r_crit")
        actions[name] = G.zone_ladder(conflict_rho(F.col("p"), F.col("u_m"), chi), G.CONFLICT_THETAS, crit)
    actions["f0_only"] = F.col("action_f0")
    out = objective_metrics(long_actions(cases, actions, "mode"), by=("mode",), base="action_nas")
    return out.withColumnRenamed("action_diff", "effect_vs_full")


# --- sensitivity -------------------------------------------------------------------------

MISSING_GRID = (0.0, 0.1, 0.2, 0.4)
DELTA_GRID = (0.1, 0.3, 0.5, 0.7)


def sensitivity_grid(cases: DataFrame, p: str = "p") -> DataFrame:
    """Actions and mean risk of all cases at each (missing rate, detail loss) point."""
    points = config_array([{"missing_rate": m, "delta": d} for m in MISSING_GRID for d in DELTA_GRID])
    rows = cases.select(F.col(p).alias("p"), F.inline(points))
    gamma = F.round(F.greatest(1.0 - F.col("p"), F.col("missing_rate")), 6)
    rows = rows.withColumn("rho", F.round(F.greatest(gamma, F.col("delta")), 6))
    action = G.zone_three(F.col("rho"))
    return rows.groupBy("missing_rate", "delta").agg(
        F.count("*").alias("n"),
        *[F.count_if(action == a).alias(f"n_{a}") for a in ("accept", "lower_confidence", "audit")],
        F.avg("rho").alias("mean_rho"),
    )


THETA_RANKS = (0.2, 0.3, 0.4, 0.5, 0.6)
CRIT_POLICIES = ("strict", "medium", "broad")
# Recorded with each result; they do not enter the formula.
LABEL_GRID = {"k_top": (3, 5, 7, 10), "delta_max": (0.15, 0.25, 0.35, 0.45), "gamma_max": (0.35, 0.45, 0.55)}


def threshold_sweep(cases: DataFrame) -> DataFrame:
    """720 rows of metrics over conflict thresholds: 15 effective configs, each listed with 48 labels."""
    grid = config_array([{"theta_rank": t, "crit_policy": c} for t in THETA_RANKS for c in CRIT_POLICIES])
    rows = cases.select(
        "p", "u_m", "topk_jaccard", "sign_disagreement", "conflict_rule", "action_f0",
        (F.col("y_true") != F.col("y_pred")).alias("wrong"), F.inline(grid),
    )
    sign = F.col("sign_disagreement") > 0
    rows = rows.withColumn("chi", (F.col("topk_jaccard") < F.col("theta_rank")) | sign | F.col("conflict_rule"))
    strict = sign & F.col("conflict_rule")
    outside = (F.col("p") < AUTO_LOW) | (F.col("p") > AUTO_HIGH)
    crit = (
        F.when(F.col("crit_policy") == "broad", F.col("chi"))
        .when(F.col("crit_policy") == "medium", strict | (F.col("chi") & outside))
        .otherwise(strict)
    )
    rows = rows.withColumn("crit", crit)
    action = G.zone_ladder(conflict_rho(F.col("p"), F.col("u_m"), F.col("chi")), G.CONFLICT_THETAS, F.col("crit"))
    rows = rows.withColumn("action", action)
    a, chi, crit = F.col("action"), F.col("chi"), F.col("crit")
    metrics = rows.groupBy("theta_rank", "crit_policy").agg(
        share(chi).alias("share_conflicts"),
        share(crit).alias("share_critical"),
        share(a != F.col("action_f0")).alias("share_action_diff"),
        share((F.col("action_f0") == "accept") & (a == "block")).alias("share_accept_to_block"),
        (F.count_if(crit & (a == "block")) / F.greatest(F.lit(1), F.count_if(crit))).alias("recall_critical"),
        F.count_if((a == "accept") & (F.col("wrong") | chi)).alias("false_auto_accept"),
        F.count_if((a == "block") & ~F.col("wrong") & ~chi & (F.col("p") < 0.35)).alias("false_block"),
    )
    labels = [dict(zip(LABEL_GRID, values)) for values in itertools.product(*LABEL_GRID.values())]
    return metrics.select("*", F.inline(config_array(labels)))


SHARES_W = (0.10, 0.15, 0.20, 0.25, 0.30)
THETAS_HIGH = (0.60, 0.70, 0.80, 0.90)


def _prefixed(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights as config fields that cannot clash with case columns."""
    return {f"w_{k}": v for k, v in weights.items()}


def _weight_columns() -> dict[str, Column]:
    return {t: F.col(f"w_{t}") for t in RISK_TERMS}


def _reweighted(weights: Mapping[str, float], w_diag: float) -> dict[str, float]:
    rest = sum(v for k, v in weights.items() if k != "diagnostic") or 1.0
    return {k: w_diag if k == "diagnostic" else v * (1.0 - w_diag) / rest for k, v in weights.items()}


def weight_sensitivity(cases: DataFrame, weights: Mapping[str, float] = RISK_WEIGHTS) -> DataFrame:
    """Accuracy against expected_action and block rate as the diagnostic weight or theta_high moves."""
    configs = [{"kind": "w_diagnostic", "setting": w, "theta_high": 0.65, **_prefixed(_reweighted(weights, w))} for w in SHARES_W]
    configs += [{"kind": "theta_high", "setting": t, "theta_high": t, **_prefixed(risk_shares(weights))} for t in THETAS_HIGH]
    rows = cases.select(
        "p", "u", "interpretability", "reduction_loss", "chi_r", "expected_action", F.inline(config_array(configs))
    )
    rho = G.config_risk(
        F.col("p"), F.col("u"), F.col("interpretability"), F.col("reduction_loss"), F.col("chi_r"), _weight_columns()
    )
    rows = rows.withColumn("rho", rho)
    action = G.gate_simple(
        F.col("rho"), F.col("u"), F.col("p"), F.col("chi_r"), GatePolicy(theta_mid=0.35), F.col("theta_high")
    )
    return rows.groupBy("kind", "setting").agg(
        share(action == F.col("expected_action")).alias("accuracy"), share(action == "block").alias("block_rate")
    )


NOISE_AMPS = (0.0, 0.02, 0.05, 0.10)


def noise_sensitivity(cases: DataFrame, case: str = "case_id", seed: int = 11, weights: Mapping[str, float] = RISK_WEIGHTS) -> DataFrame:
    """How often the action changes when interpretability is shaken by a hash-derived draw."""
    drawn = cases.withColumn("_d", 2.0 * hash_uniform(seed, F.col(case)) - 1.0)
    rows = drawn.select("*", F.explode(double_array(NOISE_AMPS)).alias("amp"))
    rows = rows.withColumn("_noisy", clip01(F.col("interpretability") + F.col("amp") * F.col("_d")))

    def act(i: Column) -> Column:
        rho = G.application_risk(F.col("p"), F.col("u"), i, F.col("reduction_loss"), F.col("chi_r"), weights)
        return G.gate_simple(rho, F.col("u"), F.col("p"), F.col("chi_r"))

    return rows.groupBy("amp").agg(
        F.avg(F.abs(F.col("_noisy") - F.col("interpretability"))).alias("mean_abs_change"),
        share(act(F.col("_noisy")) != act(F.col("interpretability"))).alias("action_change_rate"),
    )


# --- calibration of the full gate -----------------------------------------------------------

# The calibration grid (4 weightings x 3 ladders x 3^4 limits).
WEIGHT_GRID = (
    {"predicted_risk": 0.45, "uncertainty": 0.20, "interpretability_gap": 0.15, "reduction_loss": 0.10, "diagnostic": 0.10},
    {"predicted_risk": 0.50, "uncertainty": 0.20, "interpretability_gap": 0.10, "reduction_loss": 0.10, "diagnostic": 0.10},
    {"predicted_risk": 0.40, "uncertainty": 0.15, "interpretability_gap": 0.15, "reduction_loss": 0.10, "diagnostic": 0.20},
    {"predicted_risk": 0.35, "uncertainty": 0.20, "interpretability_gap": 0.15, "reduction_loss": 0.10, "diagnostic": 0.20},
)
LADDER_GRID = ((0.10, 0.25, 0.50, 0.80), (0.12, 0.28, 0.52, 0.80), (0.15, 0.30, 0.55, 0.82))
GAMMA_GRID = (0.40, 0.45, 0.50)
I_MIN_GRID = (0.60, 0.65, 0.70)
DELTA_MAX_GRID = (0.12, 0.15, 0.20)
U_MAX_GRID = (0.40, 0.45, 0.50)

GATE_METRICS = (
    "agreement_proxy", "agreement_reference", "missed_critical", "critical_recall",
    "false_auto_accept_rate", "false_block_rate", "auto_coverage",
)


def _count_at_most(x: Column, steps: Sequence[float], strict: bool = False) -> Column:
    """How many steps are <= x (or < x), which fixes the outcome of every comparison with a step."""
    total = F.lit(0)
    for s in steps:
        total = total + ((F.lit(s) < x) if strict else (F.lit(s) <= x)).cast("int")
    return total


def gate_signatures(cases: DataFrame, weight_grid=WEIGHT_GRID, gamma_grid=GAMMA_GRID, ladders=LADDER_GRID) -> DataFrame:
    """Counts of cases by everything the ladder can see.

    Each case meets 4 x 3 (weights, gamma) pairs. The other 81 configs only compare rho, loss, u and
    interpretability with fixed steps, so a case is replaced by its position among the steps.
    The result has a bounded number of rows whatever the number of cases.
    """
    configs = [
        {"w": i, "g": j, "gamma_max": g, **_prefixed(risk_shares(w))}
        for i, w in enumerate(weight_grid)
        for j, g in enumerate(gamma_grid)
    ]
    steps = sorted({t for ladder in ladders for t in ladder})
    rows = cases.select(
        "p", "u", "interpretability", "reduction_loss", "chi_r", "chi_r_crit", "chi_auto", "trace_valid",
        (F.col("y_true") != F.col("y_pred")).alias("wrong"),
        F.abs(F.col("p") - F.col("interpretability")).alias("_gap"),
        F.inline(config_array(configs)),
    )
    rows = rows.withColumn("_r", F.col("chi_r") | (F.col("_gap") > F.col("gamma_max"))).withColumn(
        "_c", F.col("chi_r_crit") | (F.col("_gap") > F.col("gamma_max") + 0.10)
    )
    p, u, i = F.col("p"), F.col("u"), F.col("interpretability")
    rho = G.config_risk(p, u, i, F.col("reduction_loss"), F.col("_r"), _weight_columns())
    keyed = rows.select(
        "w", "g",
        _count_at_most(rho, steps).alias("rho_at"),
        _count_at_most(i, I_MIN_GRID).alias("i_at"),
        _count_at_most(F.col("reduction_loss"), DELTA_MAX_GRID, strict=True).alias("d_at"),
        _count_at_most(u, U_MAX_GRID).alias("u_at"),
        F.col("_r").alias("rupture"),
        F.col("_c").alias("critical"),
        (F.col("chi_auto") & ~F.col("_c") & F.col("trace_valid")).alias("auto"),
        F.col("chi_auto").alias("auto_raw"),
        F.col("trace_valid").alias("trace_ok"),
        G.proxy_action(p, u, i, F.col("_r"), F.col("_c")).alias("proxy_action"),
        G.reference_action(p, u, i, F.col("_r"), F.col("_c"), F.col("wrong")).alias("reference_action"),
    )
    return keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n"))


def calibrate_gate(cases: DataFrame) -> DataFrame:
    """Metrics and score of all 972 configs, from the signature table."""
    steps = sorted({t for ladder in LADDER_GRID for t in ladder})
    limits = [
        {
            "t": t, "i": i, "d": d, "m": m,
            **{f"k{n + 1}": steps.index(step) for n, step in enumerate(LADDER_GRID[t])},
        }
        for t in range(len(LADDER_GRID))
        for i in range(len(I_MIN_GRID))
        for d in range(len(DELTA_MAX_GRID))
        for m in range(len(U_MAX_GRID))
    ]
    rows = gate_signatures(cases).select("*", F.inline(config_array(limits)))
    below = {n: F.col("rho_at") <= F.col(f"k{n}") for n in (1, 2, 3, 4)}
    weak = (
        (F.col("u_at") > F.col("m")) | (F.col("d_at") > F.col("d")) | (F.col("i_at") <= F.col("i")) | ~F.col("trace_ok")
    )
    auto, rupture, critical = F.col("auto"), F.col("rupture"), F.col("critical")
    action = (
        F.when(critical, "block")
        .when(~auto & ~below[3], "defer_to_human")
        .when(~auto, "request_more_data")
        .when(below[1] & ~rupture & ~weak, "accept")
        .when(below[2] & ~rupture, "lower_confidence")
        .when(weak, "request_more_data")
        .when(below[4], "defer_to_human")
        .otherwise("block")
    )
    rows = rows.withColumn("action", action)
    a, n = F.col("action"), F.sum("n")

    def part(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n")).otherwise(0)), F.lit(0))

    missed, total = part(critical & (a != "block")), part(critical)
    metrics = rows.groupBy("w", "g", "t", "i", "d", "m").agg(
        n.alias("n"),
        (part(a == F.col("proxy_action")) / n).alias("agreement_proxy"),
        (part(a == F.col("reference_action")) / n).alias("agreement_reference"),
        missed.alias("missed_critical"),
        F.when(total == 0, 1.0).otherwise((total - missed) / total).alias("critical_recall"),
        (part(is_auto(a) & ~F.col("auto_raw")) / n).alias("false_auto_accept_rate"),
        (part((a == "block") & ~critical) / n).alias("false_block_rate"),
        (part(is_auto(a)) / n).alias("auto_coverage"),
    )
    far = F.col("false_auto_accept_rate")
    penalty = (
        F.when(F.col("missed_critical") > 0, 100.0).otherwise(0.0)
        + F.when(F.col("critical_recall") < 1.0, 100.0).otherwise(0.0)
        + F.when(far > 0.10, 20.0 * (far - 0.10)).otherwise(0.0)
    )
    score = F.col("agreement_reference") - 5.0 * F.col("missed_critical") - 2.0 * far - F.col("false_block_rate") - penalty
    names = {
        "gamma_max": ("g", GAMMA_GRID), "i_min": ("i", I_MIN_GRID), "delta_max": ("d", DELTA_MAX_GRID), "u_max": ("m", U_MAX_GRID),
    }
    order = ((((F.col("w") * 3 + F.col("t")) * 3 + F.col("g")) * 3 + F.col("i")) * 3 + F.col("d")) * 3 + F.col("m")
    return metrics.select(
        order.cast("long").alias("config_id"),
        F.col("w").cast("long").alias("weights"),
        F.col("t").cast("long").alias("ladder"),
        *[F.get(double_array(grid), F.col(key)).alias(name) for name, (key, grid) in names.items()],
        "n", *GATE_METRICS, score.alias("score"),
    )


def best_gate(metrics: DataFrame) -> DataFrame:
    """The config with the best score; the earliest in grid order wins ties."""
    return metrics.orderBy(F.round("score", 12).desc(), "config_id").limit(1)


def calibrate_before_after(validation: DataFrame, test: DataFrame) -> DataFrame:
    """Best config on validation, with its metrics on validation and on test."""
    best = materialised(best_gate(calibrate_gate(validation)))
    on_test = calibrate_gate(test)
    chosen = best.select("config_id").scalar()
    rows = best.withColumn("part", F.lit("validation")).unionByName(
        on_test.where(F.col("config_id") == chosen).withColumn("part", F.lit("test"))
    )
    return rows


# --- calibration by objective ----------------------------------------------------------------

OBJECTIVE_WEIGHTS = ("w_p", "w_u", "w_i", "w_d", "w_r")
MANUAL = {"w_p": 0.35, "w_u": 0.15, "w_i": 0.20, "w_d": 0.10, "w_r": 0.20}
MANUAL_THETAS = (0.25, 0.45, 0.65, 0.82)
GRID_THETAS = (0.20, 0.40, 0.60, 0.80)
GRID_STEPS = (0.05, 0.10, 0.20, 0.30, 0.40)


def objective_candidates(spark: SparkSession, n_random: int = 5000, n_coordinate: int = 200, n_grid: int = 500, seed: int = 42) -> DataFrame:
    """Manual, grid, random and coordinate candidates as a small table built by Spark.

    The grid is filled up to n_grid with random weights under the thresholds of the grid.
    """
    first = [F.lit(MANUAL[w]).alias(w) for w in OBJECTIVE_WEIGHTS]
    th = lambda values: [F.lit(v).alias(f"t{i + 1}") for i, v in enumerate(values)]
    one = spark.range(1)
    manual = one.select(F.lit("manual").alias("method"), F.lit(0).cast("long").alias("idx"), *first, *th(MANUAL_THETAS))
    grid = one
    for name, values in {"w_p": GRID_STEPS, "w_u": GRID_STEPS, "w_i": GRID_STEPS, "w_d": (0.05, 0.10, 0.20)}.items():
        grid = grid.select("*", F.posexplode(double_array(values)).alias(f"at_{name}", name))
    idx = ((F.col("at_w_p") * 5 + F.col("at_w_u")) * 5 + F.col("at_w_i")) * 3 + F.col("at_w_d")
    rest = 1.0 - F.col("w_p") - F.col("w_u") - F.col("w_i") - F.col("w_d")
    grid = grid.withColumn("w_r", rest).where(F.col("w_r") >= 0)
    grid = grid.select(F.lit("grid").alias("method"), idx.cast("long").alias("idx"), *OBJECTIVE_WEIGHTS, *th(GRID_THETAS))
    # Normalised exponentials of uniform draws are uniform on the simplex.
    draw = lambda name: hash_uniform(seed, F.col("id"), F.lit(name))
    random = spark.range(n_random).select("id", *[(-F.log(1.0 - draw(w))).alias(w) for w in OBJECTIVE_WEIGHTS])
    total = sum((F.col(w) for w in OBJECTIVE_WEIGHTS[1:]), F.col("w_p"))
    extra = spark.range(n_grid).select("id", *[(-F.log(1.0 - hash_uniform(seed, F.col("id"), F.lit(f"grid_{w}")))).alias(w) for w in OBJECTIVE_WEIGHTS])
    room = F.lit(n_grid) - grid.agg(F.count("*")).scalar()
    extra = extra.where(F.col("id") < room).select(
        F.lit("grid").alias("method"), (1000 + F.col("id")).alias("idx"), *[(F.col(w) / total).alias(w) for w in OBJECTIVE_WEIGHTS], *th(GRID_THETAS)
    )
    cuts = F.array_sort(F.array(*[0.12 + 0.80 * draw(f"t{i}") for i in (1, 2, 3, 4)]))
    random = random.select(
        F.lit("random").alias("method"), F.col("id").alias("idx"),
        *[(F.col(w) / total).alias(w) for w in OBJECTIVE_WEIGHTS],
        *[F.get(cuts, F.lit(i)).alias(f"t{i + 1}") for i in range(4)],
    )
    moved = F.least(F.lit(0.7), 0.2 + F.col("id") / 1000.0)
    fixed = sum(v for k, v in MANUAL.items() if k != "w_r")
    coordinate = spark.range(n_coordinate).select(
        F.lit("coordinate").alias("method"), F.col("id").alias("idx"),
        *[((moved if w == "w_r" else F.lit(MANUAL[w])) / (fixed + moved)).alias(w) for w in OBJECTIVE_WEIGHTS],
        *th(MANUAL_THETAS),
    )
    return manual.unionByName(grid).unionByName(extra).unionByName(random).unionByName(coordinate)


CONFLICT_COLUMNS = ("p", "u_m", "i_pre", "delta_m", "rho_nas", "chi_r", "chi_r_crit", "wrong")
COUNTERS = ("missed_critical", "false_auto_accept", "unsafe_accept", "false_block", "excessive_defer")
# Rows that meet all candidates at once; bounds the memory of a worker: 5 MB an array of 5,701 candidates.
SCORED_AT_ONCE = 100


def _dealt(rows: DataFrame) -> DataFrame:
    """A few narrow columns dealt evenly: each row costs thousands of scores, so the shuffle is nothing beside them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _objective_counter(weights: np.ndarray, thetas: np.ndarray):
    """Counters of every candidate over the cases of a task, one row per candidate and task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, margin, n = np.zeros((5, len(weights)), np.int64), np.zeros(len(weights)), 0
        for frame in frames:
            for at in range(0, len(frame), SCORED_AT_ONCE):
                rows = frame.iloc[at : at + SCORED_AT_ONCE]
                p, u, i, d, rho_nas = (rows[c].to_numpy(float)[:, None] for c in CONFLICT_COLUMNS[:5])
                chi, crit, wrong = (rows[c].to_numpy(bool)[:, None] for c in CONFLICT_COLUMNS[5:])
                # The terms are added one by one, in the order of the query engine, so that ties fall the same way.
                w = weights.T[:, None, :]
                rho = np.clip(w[0] * p + w[1] * u + w[2] * (1.0 - i) + w[3] * d + w[4] * chi, 0.0, 1.0)
                t = thetas.T[:, None, :]
                accept, block = ~crit & (rho < t[0]), crit | (rho >= np.maximum.accumulate(t)[3])
                defer = ~crit & (rho >= np.maximum.accumulate(t)[2]) & (rho < t[3])
                low = p < 0.35
                hits = (crit & ~block, accept & (wrong | chi), accept & chi, block & ~wrong & ~chi & low, defer & ~chi & low)
                for k, h in enumerate(hits):
                    counts[k] += h.sum(axis=0)
                # One limit at a time: all four at once would be the largest array by far.
                gap = np.abs(t[0] - rho_nas)
                for limit in t[1:]:
                    np.minimum(gap, np.abs(limit - rho_nas), out=gap)
                margin += gap.sum(axis=0)
                n += len(rows)
        if n:
            yield pd.DataFrame({"at": np.arange(len(weights)), **dict(zip(COUNTERS, counts, strict=True)), "margin": margin, "n": n})

    return run


def calibrate_by_objective(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Objective and tie-breakers of every candidate over conflict cases.

    The candidates are configuration: the driver reads them once and ships them to the tasks as a matrix. A task
    scores its cases against it in blocks and returns one row of counters per candidate, so nothing is
    exploded and what is shuffled is candidates times tasks, whatever the log.
    """
    fields = ["method", "idx", *OBJECTIVE_WEIGHTS, "t1", "t2", "t3", "t4"]
    listed = candidates.select(*fields).toPandas()
    seen = _dealt(cases.withColumn("wrong", F.col("y_true") != F.col("y_pred")).select(*CONFLICT_COLUMNS))
    counter = _objective_counter(listed[list(OBJECTIVE_WEIGHTS)].to_numpy(float), listed[["t1", "t2", "t3", "t4"]].to_numpy(float))
    schema = "at long, " + ", ".join(f"{c} long" for c in COUNTERS) + ", margin double, n long"
    sums = seen.mapInPandas(counter, schema).groupBy("at").agg(*[F.sum(c).alias(c) for c in (*COUNTERS, "margin", "n")])
    table = cases.sparkSession.createDataFrame(listed.assign(at=range(len(listed))))
    out = table.join(sums, "at").select(*fields, *COUNTERS, (F.col("margin") / F.col("n")).alias("margin"))
    entropy = F.lit(0.0)
    for w in OBJECTIVE_WEIGHTS:
        entropy = entropy - F.col(w) * F.log(F.col(w) + 1e-12)
    return out.withColumn("objective", objective({k: F.col(k) for k in COUNTERS})).withColumn("weight_entropy", entropy)


def best_objective(scored: DataFrame) -> DataFrame:
    """Smallest objective, then fewer errors, lower weight entropy and wider margin."""
    return scored.orderBy(
        "objective", "missed_critical", "false_auto_accept", "unsafe_accept", "false_block", "excessive_defer",
        F.round("weight_entropy", 9), F.round(-F.col("margin"), 9), "method", "idx",
    ).limit(1)


def zero_loss_count(scored: DataFrame) -> DataFrame:
    return scored.groupBy("method").agg(
        F.count("*").alias("n_candidates"), F.count_if(F.col("objective") == 0).alias("n_zero_loss")
    )


# --- simplex calibration ------------------------------------------------------------------------

TARGET_RHO = {
    "accept": 0.15, "lower_confidence": 0.40, "request_more_data": 0.50, "defer_to_human": 0.75, "block": 1.0,
}


def simplex_grid(spark: SparkSession, units: int = 20) -> DataFrame:
    """All five-part weightings in steps of 1/units with at least one step each."""
    grid = spark.range(1)
    names = [f"n{i}" for i in range(5)]
    for name in names[:4]:
        used = sum((F.col(c) for c in grid.columns if c != "id"), F.lit(0))
        open_parts = 4 - names.index(name)
        grid = grid.select("*", F.explode(F.sequence(F.lit(1), (F.lit(units - open_parts) - used).cast("int"))).alias(name))
        grid = grid.where(used + F.col(name) <= units - open_parts)
    last = F.lit(units) - sum((F.col(c) for c in names[1:4]), F.col("n0"))
    grid = grid.withColumn("n4", last)
    return grid.select(*[(F.col(n) / float(units)).alias(t) for n, t in zip(names, RISK_TERMS)])


SIMPLEX_COLUMNS = ("p", "u", "interpretability", "reduction_loss", "chi_r")


def _simplex_counter(weights: np.ndarray, policy: GatePolicy):
    """Agreements and squared errors of every weighting over the cases of a task, one row per weighting and task."""
    names = list(TARGET_RHO)
    levels = np.array([TARGET_RHO[a] for a in names])
    # Plain numbers, so that workers need no copy of the package.
    uncertainty_max, theta_mid, theta_high = policy.uncertainty_max, policy.theta_mid, policy.theta_high

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agreed, error, n = np.zeros(len(weights), np.int64), np.zeros(len(weights)), 0
        for frame in frames:
            for at in range(0, len(frame), SCORED_AT_ONCE):
                rows = frame.iloc[at : at + SCORED_AT_ONCE]
                p, u, i, d = (rows[c].to_numpy(float)[:, None] for c in SIMPLEX_COLUMNS[:4])
                chi = rows["chi_r"].to_numpy(bool)[:, None]
                expected = rows["expected_action"].map(names.index).to_numpy()[:, None]
                times = rows["n"].to_numpy(np.int64)[:, None]
                w = weights.T[:, None, :]
                rho = np.clip(w[0] * p + w[1] * u + w[2] * (1.0 - i) + w[3] * d + w[4] * chi, 0.0, 1.0)
                unsure, mid = u >= uncertainty_max, rho >= theta_mid
                low = np.where(unsure & (p >= theta_mid), names.index("lower_confidence"), names.index("accept"))
                action = np.where(mid, np.where(unsure, names.index("request_more_data"), names.index("lower_confidence")), low)
                action = np.where(rho >= theta_high, names.index("defer_to_human"), action)
                action = np.where(chi, names.index("block"), action)
                agreed += ((action == expected) * times).sum(axis=0)
                error += ((rho - levels[expected]) ** 2 * times).sum(axis=0)
                n += int(times.sum())
        if n:
            yield pd.DataFrame({"at": np.arange(len(weights)), "agreed": agreed, "error": error, "n": n})

    return run


def calibrate_simplex(cases: DataFrame, grid: DataFrame) -> DataFrame:
    """Accuracy, squared error to the target risk and distance to the defaults of each weighting.

    Equal cases are one kind with a number. As in `calibrate_by_objective`, tasks score their kinds against the whole grid
    and return one row per weighting.
    """
    listed = grid.select(*RISK_TERMS).toPandas()
    counter = _simplex_counter(listed.to_numpy(float), GatePolicy())
    kinds = cases.groupBy(*SIMPLEX_COLUMNS, "expected_action").agg(F.count(F.lit(1)).alias("n"))
    seen = _dealt(kinds)
    sums = seen.mapInPandas(counter, "at long, agreed long, error double, n long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("agreed", "error", "n")])
    table = cases.sparkSession.createDataFrame(listed.assign(at=range(len(listed))))
    out = table.join(sums, "at").select(*RISK_TERMS, (F.col("agreed") / F.col("n")).alias("accuracy"), (F.col("error") / F.col("n")).alias("mse"))
    distance = F.lit(0.0)
    for t in RISK_TERMS:
        distance = distance + (F.col(t) - RISK_WEIGHTS[t]) * (F.col(t) - RISK_WEIGHTS[t])
    return out.withColumn("distance", distance)


def best_simplex(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.col("accuracy").desc(), F.round("mse", 12), F.round("distance", 12), *RISK_TERMS).limit(1)
