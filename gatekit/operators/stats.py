"""Bootstrap intervals, paired tests and distance constants."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_uniform, let, poisson_steps, poisson_total
from .attributions import topk_array
from .quantiles import exact_quantiles

CONFLICT_SHARES = (
    "action_diff", "accept_to_block", "false_auto_f0", "false_auto_nas", "false_block_f0", "false_block_nas",
)


def conflict_events() -> dict[str, Column]:
    f0, nas, chi, crit = F.col("action_f0"), F.col("action_nas"), F.col("chi_r"), F.col("chi_r_crit")
    wrong, low = F.col("y_true") != F.col("y_pred"), F.col("p") < 0.35
    return {
        "action_diff": f0 != nas,
        "accept_to_block": (f0 == "accept") & (nas == "block"),
        "false_auto_f0": (f0 == "accept") & (wrong | chi),
        "false_auto_nas": (nas == "accept") & (wrong | chi),
        "false_block_f0": (f0 == "block") & ~wrong & ~chi & low,
        "false_block_nas": (nas == "block") & ~wrong & ~chi & low,
        "critical": crit,
        "critical_blocked": crit & (nas == "block"),
    }


def bootstrap_sums(units: DataFrame, sums: Sequence[str], replicates: int = 5000, seed: int = 42) -> DataFrame:
    """Weighted sums per replicate, every unit weighted by a Poisson(1) draw.

    Units with the same sums are one kind: what their draws add up to is one Poisson draw of their number. The
    replicates meet the kinds, not the units. Kinds of single cases do not grow with the log; kinds of objects do, and each
    takes a draw per replicate in its task, which hands on one row of sums per replicate.
    """
    kinds = units.groupBy(*sums).agg(F.count("*").alias("_units")).withColumn("_steps", poisson_steps(F.col("_units")))
    kinds = kinds.withColumn("_kind", F.concat_ws(",", *[F.col(s).cast("string") for s in sums]))
    rows = kinds.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    draw = let(hash_uniform(seed, F.col("rep"), F.col("_kind")), lambda u: poisson_total(u, F.col("_units"), F.col("_steps")))
    rows = rows.select("rep", *sums, draw.alias("w"))
    return rows.groupBy("rep").agg(*[F.sum(F.col(s) * F.col("w")).alias(s) for s in sums])


def _intervals(sums: DataFrame, names: Mapping[str, Column], prefix: str) -> DataFrame:
    """2.5 and 97.5 percentiles over replicates; the input has one row per replicate."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in names.items()])
    long = sums.select(F.inline(pairs))
    q = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("metric").agg(q.alias("q")).select(
        "metric", F.get("q", F.lit(0)).alias(f"{prefix}_low"), F.get("q", F.lit(1)).alias(f"{prefix}_high")
    )


def bootstrap_ci(cases: DataFrame, entity: str = "object_id", replicates: int = 5000, seed: int = 42) -> DataFrame:
    """Estimates with intervals by case and by object for the conflict shares and critical recall."""
    events = conflict_events()
    names = list(events)
    flags = cases.select(entity, F.lit(1).cast("long").alias("n"), *[c.cast("long").alias(k) for k, c in events.items()])
    per_object = flags.groupBy(entity).agg(*[F.sum(k).alias(k) for k in ("n", *names)])
    metrics = {k: F.col(k) / F.col("n") for k in CONFLICT_SHARES}
    metrics["recall_critical"] = F.col("critical_blocked") / F.greatest(F.lit(1), F.col("critical"))
    by_case = _intervals(bootstrap_sums(flags, ["n", *names], replicates, seed), metrics, "case")
    by_object = _intervals(bootstrap_sums(per_object, ["n", *names], replicates, seed), metrics, "object")
    totals = per_object.agg(*[F.sum(k).alias(k) for k in ("n", *names)])
    estimates = totals.select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("estimate")) for k, v in metrics.items()]))
    )
    return estimates.join(by_case, "metric").join(by_object, "metric")


def log_factorial(n: Column) -> Column:
    """log(n!): exact values below 20, Stirling's series above (error below 1e-13)."""
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(20)])
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 20, F.get(small, n.cast("int"))).otherwise(series)


def binomial_two_sided(low: Column, n: Column) -> Column:
    """Exact two-sided tail 2*P(X <= low) for X ~ Bin(n, 1/2), low <= n/2, capped at 1.

    The largest term comes from log factorials; the terms below it are added relative to it. They
    vanish within a few multiples of sqrt(n), so the number of steps is bounded by that.
    """
    steps = F.least(low.cast("double"), 10.0 * F.sqrt(n.cast("double")) + 50.0).cast("long")
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, j: F.struct(
            (acc["term"] * (low - j) / (n - low + j + 1)).alias("term"), (acc["total"] + acc["term"]).alias("total")
        ),
    )["total"]
    log_top = log_factorial(n) - log_factorial(low) - log_factorial(n - low)
    p = F.exp(log_top + F.log(tail) - (n - 1) * math.log(2.0))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def mcnemar(cases: DataFrame, a: str, b: str, entity: str = "object_id", replicates: int = 5000, seed: int = 42) -> DataFrame:
    """Paired test of two gates on blocking critical cases, with an object-level interval of the effect."""
    ba, bb, crit = F.col(a) == "block", F.col(b) == "block", F.col("chi_r_crit")
    per_object = cases.groupBy(entity).agg(
        F.count("*").alias("n"),
        F.count_if(crit & ~ba & bb).alias("gained"),
        F.count_if(crit & ba & ~bb).alias("lost"),
        (F.count_if(bb) - F.count_if(ba)).alias("diff"),
    )
    totals = per_object.agg(*[F.sum(c).alias(c) for c in ("n", "gained", "lost", "diff")])
    ci = _intervals(bootstrap_sums(per_object, ["n", "diff"], replicates, seed), {"effect": F.col("diff") / F.col("n")}, "ci")
    interval = ci.select(F.struct("ci_low", "ci_high")).scalar()
    discordant = F.col("gained") + F.col("lost")
    return totals.withColumn("_ci", interval).select(
        discordant.alias("n_discordant"),
        binomial_two_sided(F.least("gained", "lost"), discordant).alias("p_value"),
        (F.col("diff") / F.col("n")).alias("effect_size"),
        F.col("_ci.ci_low").alias("ci_low"),
        F.col("_ci.ci_high").alias("ci_high"),
    )


# --- distance constants -----------------------------------------------------------------

def _entropy_bits(values: Sequence[Column]) -> Column:
    total = sum(values[1:], values[0])
    out = F.lit(0.0)
    for v in values:
        q = v / F.when(total == 0, 1.0).otherwise(total)
        out = out - q * F.log2(F.greatest(q, F.lit(1e-12)))
    return out


def _triple(p: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [F.greatest(zero, 1.0 - p), F.greatest(zero, 1.0 - F.abs(p - 0.5) / 0.25), F.greatest(zero, p)]


def pair_distances(pairs: DataFrame, p_a: str, p_b: str, x_a: str, x_b: str, k: int = 5) -> DataFrame:
    """Entropy, membership and top-k distances between a case and its perturbed twin."""
    m0, m1 = _triple(F.col(p_a)), _triple(F.col(p_b))
    h = F.abs(_entropy_bits(m0) - _entropy_bits(m1))
    o = F.abs(F.greatest(*m0) - F.greatest(*m1)) + F.abs(F.col(p_a) - F.col(p_b))
    fa = F.transform(topk_array(F.col(x_a), k), lambda s: s["feature"])
    fb = F.transform(topk_array(F.col(x_b), k), lambda s: s["feature"])
    jac = 1.0 - F.size(F.array_intersect(fa, fb)) / F.greatest(F.lit(1), F.size(F.array_union(fa, fb)))
    return pairs.select("*", h.alias("h_distance"), o.alias("o_distance"), jac.alias("k_distance"))


def distance_constants(distances: DataFrame, top_below: int = 0) -> DataFrame:
    """95th percentile of each distance; the maximum where there are fewer than top_below pairs."""
    names = {"c_H": "h_distance", "c_O": "o_distance", "c_K": "k_distance"}
    pairs = F.array(*[F.struct(F.lit(k).alias("constant"), F.col(v).alias("value")) for k, v in names.items()])
    q = exact_quantiles(distances.select(F.inline(pairs)), "value", {"q95": 0.95, "top": 1.0}, keys=["constant"], few_keys=True)
    return q.select("constant", F.when(F.col("n_values") < top_below, F.col("top")).otherwise(F.col("q95")).alias("value"), F.col("n_values").alias("n_pairs"))


def scaled(values: Column, scale: Column) -> Column:
    return F.zip_with(values, scale, lambda v, s: v / F.when(s == 0, 1.0).otherwise(s))


def perturb(values: Column, scale: Column, case: Column, amp: float = 0.03, seed: int = 42) -> Column:
    """Shift each entry by a hash-derived draw in [-amp, amp] times its scale."""
    return F.transform(
        F.arrays_zip(values.alias("v"), scale.alias("s")),
        lambda q, i: q["v"] + amp * q["s"] * (2.0 * hash_uniform(seed, case, i) - 1.0),
    )
