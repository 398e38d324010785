"""Joining, composing and aligning explanations.

An explanations table has one row per case:
    case_id, terms array<string>, representation struct, rules array<struct>,
    activations map<string,double>, uncertainty, trace struct, reduction_loss
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.disagreement import prob_or, semantic_disagreement, severity
from ..functions.numeric import string_array
from ..plans.plan import BETA

PARTS = ("terms", "representation", "rules", "activations", "uncertainty", "trace", "reduction_loss")


def pair_up(left: DataFrame, right: DataFrame, on: str = "case_id") -> DataFrame:
    """Inner join of two explanation tables into l_* and r_* columns.

    A plain equi-join: Spark picks broadcast or sort-merge by size, and AQE splits skewed keys.
    """
    l = left.select(on, *[F.col(c).alias(f"l_{c}") for c in PARTS])
    r = right.select(on, *[F.col(c).alias(f"r_{c}") for c in PARTS])
    return l.join(r, on)


def side(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}_{c}") for c in PARTS}


def disagreement(pairs: DataFrame, beta: Mapping[str, float] = BETA) -> DataFrame:
    return pairs.withColumn("gamma", semantic_disagreement(side("l"), side("r"), beta))


def edge_report(pairs: DataFrame, beta: Mapping[str, float] = BETA) -> DataFrame:
    """Rounded disagreement with a severity band, one row per pair."""
    from ..functions.fuzzy import active_rules

    scored = disagreement(pairs, beta)
    return scored.select(
        "case_id",
        F.round("gamma", 6).alias("gamma"),
        severity(F.col("gamma")).alias("severity"),
        F.array_sort("l_terms").alias("left_terms"),
        F.array_sort("r_terms").alias("right_terms"),
        F.array_sort(active_rules(F.col("l_rules"), F.col("l_activations"))).alias("left_active"),
        F.array_sort(active_rules(F.col("r_rules"), F.col("r_activations"))).alias("right_active"),
        F.col("l_reduction_loss").alias("left_delta"),
        F.col("r_reduction_loss").alias("right_delta"),
    )


def compose_pair(pairs: DataFrame, beta: Mapping[str, float] = BETA, gamma_max: float | None = None, allow_missing_terms: bool = False) -> DataFrame:
    """Compose left then right, or report why it cannot be done in the diagnostic column."""
    scored = disagreement(pairs, beta)
    l, r = side("l"), side("r")
    no_terms = (F.size(F.array_intersect(l["terms"], r["terms"])) == 0) & F.lit(not allow_missing_terms)
    too_far = F.col("gamma") > gamma_max if gamma_max is not None else F.lit(False)
    reason = F.when(no_terms, "no common terms").when(too_far, "disagreement above gamma_max")
    left_names = F.transform(l["rules"], lambda x: x["name"])
    rules = F.concat(l["rules"], F.filter(r["rules"], lambda x: ~F.array_contains(left_names, x["name"])))
    activations = F.map_zip_with(
        l["activations"], r["activations"], lambda _, a, b: F.greatest(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0)))
    )
    ok = reason.isNull()

    def composed(value: Column) -> Column:
        return F.when(ok, value)

    return scored.select(
        "case_id",
        "gamma",
        F.when(~ok, F.lit("D_ij")).alias("diagnostic"),
        reason.alias("reason"),
        composed(F.array_union(l["terms"], r["terms"])).alias("terms"),
        composed(r["representation"]).alias("representation"),
        composed(rules).alias("rules"),
        composed(activations).alias("activations"),
        composed(prob_or(l["uncertainty"], r["uncertainty"], F.col("gamma"))).alias("uncertainty"),
        composed(r["trace"]).alias("trace"),
        composed(F.least(F.lit(1.0), l["reduction_loss"] + r["reduction_loss"])).alias("reduction_loss"),
    )


def compose_chain(stages: DataFrame, gamma_max: float, case: str = "case_id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Compose the stages of each case in order and stop at the first stage whose gamma is too large.

    Stages carry gamma (disagreement with the stage before, null for the first), uncertainty,
    reduction_loss and activations. Products, sums and maxima do not depend on row order, so the
    fold is two partial aggregations, and a case with very many stages is combined map-side.
    """
    position = F.struct(*order)
    broken = F.col("gamma") > gamma_max
    stops = stages.groupBy(case).agg(F.min(F.when(broken, position)).alias("stop"), F.count("*").alias("n_stages"))
    kept = stages.join(stops, case).where(F.col("stop").isNull() | (position < F.col("stop")))

    # log(1-v) sums to the log of the product; a value of 1 makes the product 0.
    def log_keep(v: Column) -> Column:
        return F.sum(F.log1p(-F.least(v, F.lit(1.0 - 1e-15))))

    def certain(v: Column) -> Column:
        return F.max(F.when(v >= 1.0, 1).otherwise(0))

    u, g = F.col("uncertainty"), F.coalesce(F.col("gamma"), F.lit(0.0))
    totals = kept.groupBy(case).agg(
        F.first("n_stages").alias("n_stages"),
        F.count("*").alias("n_composed"),
        F.first(F.col("stop").isNotNull()).alias("stopped"),
        F.when((certain(u) == 1) | (certain(g) == 1), 1.0)
        .otherwise(1.0 - F.exp(log_keep(u) + log_keep(g)))
        .alias("uncertainty"),
        F.least(F.lit(1.0), F.sum("reduction_loss")).alias("reduction_loss"),
    )
    return totals.withColumn("diagnostic", F.when(F.col("stopped"), F.lit("D_ij")))


def chain_activations(stages: DataFrame, case: str = "case_id") -> DataFrame:
    """Largest activation per case and rule over composed stages."""
    return stages.select(case, F.explode("activations").alias("rule", "activation")).groupBy(case, "rule").agg(
        F.max("activation").alias("activation")
    )


def align_candidates(pairs: DataFrame, candidates: Sequence[Mapping], lam: float = 0.2, gamma_max: float = 0.4) -> DataFrame:
    """Cheapest admissible alignment of each pair out of a finite candidate list.

    Each candidate has name, term_map, rule_map and activation_scale. Candidates are literals,
    scored inside the row; the first of equal costs wins.
    """
    l, r = side("l"), side("r")
    l_names = F.transform(l["rules"], lambda x: x["name"])
    r_names = F.transform(r["rules"], lambda x: x["name"])
    options = []
    for pos, cand in enumerate(candidates):
        terms, rules = dict(cand["term_map"]), dict(cand["rule_map"])
        scale = float(cand.get("activation_scale", 1.0))
        src_terms, dst_terms = string_array(list(terms)), string_array(list(terms.values()))
        admissible = (F.size(F.array_except(src_terms, l["terms"])) == 0) & (F.size(F.array_except(dst_terms, r["terms"])) == 0)
        # Term maps of admissible candidates match in full.
        term_gap = 1.0 - F.lit(float(len(terms))) / F.greatest(F.lit(1), F.size(F.array_union(l["terms"], src_terms)))
        hit, gap, compared = F.lit(0.0), F.lit(0.0), F.lit(0.0)
        for src, dst in rules.items():
            hit = hit + (F.array_contains(l_names, src) & F.array_contains(r_names, dst)).cast("double")
            a, b = F.element_at(l["activations"], F.lit(src)), F.element_at(r["activations"], F.lit(dst))
            both = a.isNotNull() & b.isNotNull()
            gap = gap + F.when(both, F.abs(a * scale - b)).otherwise(0.0)
            compared = compared + both.cast("double")
        rule_gap = 1.0 - hit / F.greatest(F.lit(1), F.size(F.array_union(l_names, string_array(list(rules)))))
        mean_gap = F.when(compared > 0, gap / compared).otherwise(0.0)
        gamma = F.least(F.lit(1.0), mean_gap + 0.5 * term_gap + 0.3 * rule_gap)
        delta = F.least(F.lit(1.0), F.abs(l["reduction_loss"] - r["reduction_loss"]) + 0.25 * term_gap)
        options.append(
            F.when(
                admissible,
                F.struct(
                    F.round(gamma + lam * delta, 6).alias("cost"),
                    F.lit(pos).alias("pos"),
                    F.lit(str(cand["name"])).alias("name"),
                    F.round(gamma, 6).alias("gamma"),
                    F.round(delta, 6).alias("delta_t"),
                ),
            )
        )
    best = pairs.withColumn("_best", F.array_min(F.array_compact(F.array(*options))))
    b = F.col("_best")
    return best.select(
        "case_id",
        b["name"].alias("alignment"),
        b["gamma"].alias("gamma"),
        b["delta_t"].alias("delta_t"),
        b["cost"].alias("cost"),
        F.when(b.isNull(), "no_admissible_alignment_candidate")
        .when(b["cost"] > gamma_max, "alignment_cost_exceeds_gamma_max")
        .alias("diagnostic"),
    )


def weighted_mean(components: DataFrame, weights: Mapping[str, float], case: str = "case_id", out: str = "gamma") -> DataFrame:
    """Weighted mean of long component rows (case, component, value) per case.

    Weights are a literal map. Components without a weight are counted in n_missing.
    """
    if any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must have a positive sum")
    lookup = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    w = F.element_at(lookup, F.col("component"))
    return components.groupBy(case).agg(
        (F.sum(F.col("value") * w) / F.sum(w)).alias(out), F.count_if(w.isNull()).alias("n_missing")
    )


def certify_alignment(scored: DataFrame, gamma_max: float, delta_max: float) -> DataFrame:
    return scored.withColumn("certified", (F.col("gamma") <= gamma_max) & (F.col("delta_t") <= delta_max))


def missing_weights(components: DataFrame, weights: DataFrame) -> DataFrame:
    """Component names that have no weight: an anti join on the distinct names."""
    return components.select("component").distinct().join(weights.select("component"), "component", "left_anti")


# --- contexts --------------------------------------------------------------------

def auto_accept_context(actions: Column) -> Column:
    """Automatic actions among the allowed ones, sorted."""
    return F.array_sort(F.array_intersect(actions, F.array(F.lit("accept"), F.lit("lower_confidence"))))
