"""Uncertainty of a predicted distribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clip01, let

EPS = 1e-12


def entropy_uncertainty(proba: Column) -> Column:
    """Normalised entropy of a probability array."""
    def entropy(clipped: Column) -> Column:
        # With S the sum of the values v, the entropy of v/S is log S - sum(v log v)/S.
        sums = F.aggregate(
            clipped,
            F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("vlogv")),
            lambda acc, v: F.struct(
                (acc["s"] + v).alias("s"), (acc["vlogv"] + v * F.log(F.greatest(v, F.lit(EPS)))).alias("vlogv")
            ),
        )

        def raw(t: Column) -> Column:
            total = F.greatest(t["s"], F.lit(EPS))
            return F.log(total) - t["vlogv"] / total

        return clip01(let(sums, raw) / F.log(F.size(clipped).cast("double")))

    return F.when(F.size(proba) <= 1, 0.0).otherwise(let(F.transform(proba, clip01), entropy))


def margin_uncertainty(proba: Column) -> Column:
    """One minus the gap between the two largest probabilities."""
    ordered = F.sort_array(F.transform(proba, clip01), asc=False)
    gap = let(ordered, lambda o: F.get(o, F.lit(0)) - F.get(o, F.lit(1)))
    return F.when(F.size(proba) <= 1, 0.0).otherwise(clip01(1.0 - gap))


def blended_uncertainty(entropy: Column, margin: Column) -> Column:
    return clip01(0.70 * entropy + 0.30 * margin)


def binary_entropy(p: Column) -> Column:
    """Entropy form for two classes, without arrays, so it stays in generated code."""
    q = 1.0 - p
    return clip01(
        -(q * F.log(F.greatest(q, F.lit(EPS))) + p * F.log(F.greatest(p, F.lit(EPS)))) / F.log(F.lit(2.0))
    )


def binary_margin(p: Column) -> Column:
    return clip01(1.0 - F.abs((1.0 - p) - p))


def binary_uncertainty(p: Column) -> Column:
    return blended_uncertainty(binary_entropy(p), binary_margin(p))


def scores_to_proba(score: Column) -> Column:
    """Logistic of a decision score as a two-class array."""
    p1 = 1.0 / (1.0 + F.exp(-score))
    return F.array(1.0 - p1, p1)


def label_to_proba(label: Column) -> Column:
    y = label.cast("double")
    return F.array(1.0 - y, y)
