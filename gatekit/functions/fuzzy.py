"""Memberships, rule activations and explanation uncertainty."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.plan import ETA
from .numeric import clip01, let


def risk_memberships(z: Column) -> dict[str, Column]:
    """Low, medium and high membership of a risk in [0,1]."""
    return {
        "low": clip01((0.5 - z) / 0.5),
        "medium": F.when((z >= 0.25) & (z <= 0.5), 4 * z - 1)
        .when((z > 0.5) & (z <= 0.75), 3 - 4 * z)
        .otherwise(F.lit(0.0)),
        "high": F.when((z >= 0.5) & (z <= 0.75), 4 * z - 2)
        .when((z > 0.75) & (z <= 1.0), F.lit(1.0))
        .otherwise(F.lit(0.0)),
    }


def membership_map(memberships: Mapping[str, Column]) -> Column:
    return F.create_map(*[part for name, col in memberships.items() for part in (F.lit(name), col)])


def source_memberships(p: Column) -> dict[str, Column]:
    """Memberships used when a source supplies only one score."""
    return {"low": clip01(1.0 - p * 1.4), "medium": clip01(1.0 - F.abs(p - 0.5) * 4.0), "high": clip01(p)}


def left_shoulder(x: Column, a: Column, b: Column) -> Column:
    return F.when(x <= a, 1.0).when(x >= b, 0.0).otherwise((b - x) / F.greatest(b - a, F.lit(1e-12)))


def right_shoulder(x: Column, a: Column, b: Column) -> Column:
    return F.when(x <= a, 0.0).when(x >= b, 1.0).otherwise((x - a) / F.greatest(b - a, F.lit(1e-12)))


def triangle(x: Column, a: Column, b: Column, c: Column) -> Column:
    return (
        F.when((x <= a) | (x >= c), 0.0)
        .when(F.abs(x - b) < 1e-12, 1.0)
        .when(x < b, (x - a) / F.greatest(b - a, F.lit(1e-12)))
        .otherwise((c - x) / F.greatest(c - b, F.lit(1e-12)))
    )


def rule_activations(memberships: Column, rules: Column) -> Column:
    """Activation of each rule: the membership of its risk term, 0 when it has none."""
    return F.map_from_entries(
        F.transform(
            rules,
            lambda r: F.struct(
                r["name"].alias("key"),
                F.coalesce(F.element_at(memberships, r["conditions"]["risk"]), F.lit(0.0)).alias("value"),
            ),
        )
    )


def active_rules(rules: Column, activations: Column, threshold: float = 0.05) -> Column:
    """Names of the rules that fire strictly above the threshold."""
    names = F.array_distinct(F.transform(rules, lambda r: r["name"]))
    return F.filter(names, lambda n: F.coalesce(F.element_at(activations, n), F.lit(0.0)) > threshold)


def max_activation(activations: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(activations)), F.lit(0.0))


def explanation_uncertainty(u_model: Column, top_activation: Column, u_trace: Column, eta: Mapping[str, float] = ETA) -> Column:
    return clip01(eta["model"] * u_model + eta["rules"] * (1.0 - top_activation) + eta["trace"] * u_trace)


def tabular_uncertainty(p: Column, missing_rate: Column) -> Column:
    m = source_memberships(p)
    return clip01((1.0 - F.abs(m["high"] - m["low"])) * 0.8 + missing_rate * 0.2)


# Words that point to high or low risk in a text.
HIGH_WORDS = ("critical", "sepsis", "hemorrhage", "cancer", "acute")
LOW_WORDS = ("stable", "negative", "normal", "no signs")


def text_conflict(text: Column) -> Column:
    """True when a text has both a high-risk and a low-risk word. Reads the whole text."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return lowered.rlike("|".join(HIGH_WORDS)) & lowered.rlike("|".join(LOW_WORDS))


def text_uncertainty(p: Column, conflict: Column) -> Column:
    m = source_memberships(p)
    return clip01((1.0 - F.abs(m["high"] - m["low"])) * 0.8 + 0.2 * conflict.cast("double"))


def image_meta_uncertainty(p: Column, meta: Column) -> Column:
    m = source_memberships(p)
    missing = sum(
        (F.trim(F.coalesce(F.element_at(meta, key), F.lit(""))) == "").cast("double") for key in ("modality", "protocol")
    )
    return clip01((1.0 - F.abs(m["high"] - m["low"])) * 0.75 + 0.125 * missing)


def membership_entropy(values: Column, eps: float = 1e-3) -> Column:
    """Normalised entropy of a membership array; 0 for arrays of at most one value."""
    def entropy(shifted: Column) -> Column:
        # With S the sum of the values v, the entropy of v/S is log S - sum(v log v)/S.
        sums = F.aggregate(
            shifted,
            F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("vlogv")),
            lambda acc, v: F.struct((acc["s"] + v).alias("s"), (acc["vlogv"] + v * F.log(v)).alias("vlogv")),
        )
        return let(sums, lambda t: F.log(t["s"]) - t["vlogv"] / t["s"]) / F.log(F.size(shifted).cast("double"))

    return F.when(F.size(values) <= 1, 0.0).otherwise(let(F.transform(values, lambda v: clip01(v) + eps), entropy))
