"""Feature attributions: top-k, conflicts between methods, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.gates import CONFLICT_THETAS, zone_ladder
from ..functions.numeric import array_mean, array_sum, clip01

# Fixed values of the conflict rules.
THETA_RANK = 0.4
AUTO_LOW, AUTO_HIGH = 0.30, 0.70


def topk_array(values: Column, k: int) -> Column:
    """Top k entries of an attribution array by absolute value as structs (feature, value, sign).

    Features are positions from 0; equal magnitudes go to the lower position. No shuffle.
    """
    tagged = F.transform(
        values, lambda v, i: F.struct((-F.abs(v)).alias("k"), i.alias("feature"), v.alias("value"), F.signum(v).alias("sign"))
    )
    return F.transform(
        F.slice(F.array_sort(tagged), 1, k),
        lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value"), s["sign"].alias("sign")),
    )


def topk_attributions(long: DataFrame, k: int, keys: Sequence[str] = ("case_id", "method")) -> DataFrame:
    """Top k rows of a long attribution table per case and method.

    Spark turns the rank filter into a limit per group before the shuffle, so a hot case
    ships at most k rows from each input task.
    """
    w = Window.partitionBy(*keys).orderBy(F.abs("value").desc(), F.col("feature"))
    ranked = long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("sign", F.signum("value").cast("long"))


def attribution_conflict(df: DataFrame, p: str, a: str, b: str, k: int = 5, variant: str = "practice") -> DataFrame:
    """Conflict flags between two attribution arrays of a case, and the risk at three levels.

    Everything is computed inside the row; the table is neither exploded nor shuffled.
    """
    top = df.withColumn("_a", topk_array(F.col(a), k)).withColumn("_b", topk_array(F.col(b), k))
    fa, fb = F.transform("_a", lambda s: s["feature"]), F.transform("_b", lambda s: s["feature"])
    opposite = F.filter(
        "_a", lambda s: F.exists("_b", lambda t: (t["feature"] == s["feature"]) & (t["sign"] * s["sign"] < 0))
    )
    support = F.transform("_a", lambda s: s["sign"]), F.transform("_b", lambda s: s["sign"])
    risk = F.col(p)
    counted = top.select(
        *df.columns,
        (F.size(F.array_intersect(fa, fb)) / F.size(F.array_union(fa, fb))).alias("topk_jaccard"),
        F.size(opposite).cast("long").alias("sign_disagreement"),
        (array_mean(support[0]) + array_mean(support[1])).alias("_support"),
        F.when(risk >= AUTO_HIGH, "block").when(risk <= AUTO_LOW, "accept").otherwise("defer_to_human").alias("rule_action"),
        (1.0 - 2.0 * F.abs(risk - 0.5)).alias("u_m"),
    )
    rule = ((F.col("rule_action") == "block") & (F.col("_support") < -0.25)) | (
        (F.col("rule_action") == "accept") & (F.col("_support") > 0.25)
    )
    flagged = counted.select(
        *[c for c in counted.columns if c != "_support"],
        (F.col("topk_jaccard") < THETA_RANK).alias("conflict_rank"),
        (F.col("sign_disagreement") > 0).alias("conflict_sign"),
        rule.alias("conflict_rule"),
        clip01(F.col("topk_jaccard") - 0.2 * F.col("sign_disagreement")).alias("i_pre"),
    )
    return conflict_risk_levels(conflict_flags(flagged, p), p, variant)


def conflict_flags(df: DataFrame, p: str) -> DataFrame:
    any_conflict = F.col("conflict_rank") | F.col("conflict_sign") | F.col("conflict_rule")
    outside = (F.col(p) <= AUTO_LOW) | (F.col(p) >= AUTO_HIGH)
    return df.withColumn("chi_r", any_conflict).withColumn(
        "chi_r_crit", (F.col("conflict_sign") & F.col("conflict_rule")) | (any_conflict & outside)
    )


def conflict_rho(p: Column, u: Column, chi: Column) -> Column:
    return clip01(0.55 * p + 0.25 * u + 0.20 * chi.cast("double"))


def conflict_risk_levels(df: DataFrame, p: str = "p", variant: str = "practice") -> DataFrame:
    """Risk and action from the probability alone, with the conflict flag, and with interpretability."""
    chi = F.col("chi_r").cast("double")
    if variant == "practice":
        gap = 1.0 - F.col("i_pre")
    elif variant == "evidence":
        gap = clip01(
            1.0 - F.col("topk_jaccard") + 0.20 * F.col("sign_disagreement") + 0.25 * F.col("conflict_rule").cast("double")
        )
    else:
        raise ValueError(f"unknown variant {variant!r}")
    crit = F.col("chi_r_crit")
    leveled = df.withColumn("rho_f0", F.col(p)).withColumn("rho_nas", conflict_rho(F.col(p), F.col("u_m"), F.col("chi_r")))
    leveled = leveled.withColumn("rho_fml", clip01(0.50 * F.col("rho_nas") + 0.25 * gap + 0.25 * chi))
    return leveled.select(
        "*",
        zone_ladder(F.col("rho_f0"), CONFLICT_THETAS).alias("action_f0"),
        zone_ladder(F.col("rho_nas"), CONFLICT_THETAS, crit).alias("action_nas"),
        zone_ladder(F.col("rho_fml"), CONFLICT_THETAS, crit).alias("action_fml"),
        F.abs(F.col("rho_fml") - F.col("rho_f0")).alias("delta_m"),
    )


def coverage_curve(df: DataFrame, importances: str, keys: Sequence[str]) -> DataFrame:
    """Coverage and remaining loss after the k most important features, one row per k."""
    ordered = F.sort_array(F.col(importances), asc=False)
    running = F.aggregate(
        ordered,
        F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out")),
        lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.array_append(acc["out"], acc["s"] + v).alias("out")),
    )["out"]
    rows = df.select(*keys, F.posexplode(running).alias("k", "total"))
    return rows.select(
        *keys,
        (F.col("k") + 1).cast("long").alias("k"),
        F.least(F.col("total"), F.lit(1.0)).alias("coverage"),
        F.greatest(1.0 - F.col("total"), F.lit(0.0)).alias("delta"),
    )


def normalise_topk(df: DataFrame, importances: str, k: int, keys: Sequence[str]) -> DataFrame:
    """Shares of the k largest importances per case, one row per kept feature."""
    total = array_sum(F.col(importances))
    total = F.when(total == 0, 1.0).otherwise(total)
    # Largest first; ties go to the lower position.
    tagged = F.transform(importances, lambda v, i: F.struct((-v).alias("neg"), i.alias("feature")))
    scaled = df.withColumn("_total", total).withColumn("_top", F.slice(F.array_sort(tagged), 1, k))
    return scaled.select(*keys, "_total", F.inline("_top")).select(
        *keys, F.col("feature").cast("long").alias("feature"), F.round(-F.col("neg") / F.col("_total"), 6).alias("share")
    )


def route_gap(p: Column, activations: Column, attributions: Column) -> Column:
    """Gap between a risk and what the rules and the positive attributions support."""
    mean_alpha = array_mean(F.transform(activations, clip01))
    support = clip01(array_sum(F.transform(attributions, lambda v: F.greatest(F.lit(0.0), v))))
    return F.greatest(F.abs(clip01(p) - mean_alpha), F.abs(clip01(p) - support))


def rule_attribution_gap(alpha: Column, first: Column, second: Column) -> Column:
    return (F.abs(alpha - second) + F.abs(alpha - first)) / 2.0


def counterevidence_counts(fragments: DataFrame, entity: str) -> DataFrame:
    """Fragments, support and counter-evidence per object. Partial sums before the shuffle."""
    return fragments.groupBy(entity).agg(
        F.count("*").alias("n_fragments"),
        F.count_if(F.col("support") == 1).alias("n_support"),
        F.count_if(F.col("counter") == 1).alias("n_counter"),
        (F.count_if(F.col("counter") == 1) > 0).alias("has_counter"),
    )


def signal_quality(samples: DataFrame, keys: Sequence[str], rate: int = 250, quality_min: float = 0.58, missing_max: int = 2) -> DataFrame:
    """Noise, missing samples, constant sampling rate and mean quality per signal."""
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n_samples"),
        F.count_if(F.col("noise_mask") == 1).alias("n_noise"),
        F.count_if(F.col("missing_mask") == 1).alias("n_missing"),
        ((F.min("sampling_rate") == F.max("sampling_rate")) & (F.min("sampling_rate") == rate)).alias("rate_ok"),
        F.avg("quality_score").alias("quality"),
        ((F.avg("quality_score") < quality_min) | (F.count_if(F.col("missing_mask") == 1) > missing_max)).alias("limited"),
    )


def triage_summary(signals: DataFrame) -> DataFrame:
    """Counts of valid, rejected, manually checked and audited signals."""
    return signals.agg(
        F.count("*").alias("total_signals"),
        F.count_if(F.col("adapter_status") == "valid").alias("valid"),
        F.count_if(F.col("adapter_status") != "valid").alias("rejected"),
        F.count_if("manual_required_baseline").alias("manual_before"),
        F.count_if(F.col("action") == "manual_check").alias("manual_after"),
        F.count_if(F.col("action") == "audit_report").alias("audit_reports"),
    )


def reject_reasons(signals: DataFrame) -> DataFrame:
    return signals.where(F.col("adapter_status") != "valid").groupBy("reject_reason").agg(F.count("*").alias("n"))
