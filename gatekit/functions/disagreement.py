"""Disagreement between two explanations, and interpretability of one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.plan import BETA, LAMBDA
from .fuzzy import active_rules, membership_entropy
from .numeric import array_mean, array_sum, clip01, let
from .representation import representation_distance

TRACE_FIELDS = ("id", "version", "timestamp", "source", "checksum")


def jaccard_gap(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(1.0 - F.size(F.array_intersect(a, b)) / union)


def activation_gap(a: Column, b: Column) -> Column:
    """Mean absolute gap over the union of the activation keys; a missing key counts as 0."""
    gaps = F.map_values(
        F.map_zip_with(a, b, lambda _, x, y: F.abs(F.coalesce(x, F.lit(0.0)) - F.coalesce(y, F.lit(0.0))))
    )
    return array_mean(gaps)


def trace_gap(a: Column, b: Column) -> Column:
    """Share of the six trace fields that differ."""
    differs = [(~a[f].eqNullSafe(b[f])).cast("double") for f in TRACE_FIELDS]
    params = [F.array_sort(F.map_entries(t["params"])) for t in (a, b)]
    differs.append((~params[0].eqNullSafe(params[1])).cast("double"))
    return sum(differs[1:], differs[0]) / 6.0


def semantic_disagreement(left: Mapping[str, Column], right: Mapping[str, Column], beta: Mapping[str, float] = BETA, threshold: float = 0.05) -> Column:
    """Weighted gap of two explanations given as dicts of columns.

    Keys: representation, rules, activations, uncertainty, trace, reduction_loss.
    """
    parts = {
        "repr": lambda: representation_distance(left["representation"], right["representation"]),
        "rules": lambda: jaccard_gap(
            active_rules(left["rules"], left["activations"], threshold),
            active_rules(right["rules"], right["activations"], threshold),
        ),
        "activations": lambda: activation_gap(left["activations"], right["activations"]),
        "uncertainty": lambda: F.abs(left["uncertainty"] - right["uncertainty"]),
        "trace": lambda: trace_gap(left["trace"], right["trace"]),
        "reduction": lambda: F.least(F.lit(1.0), left["reduction_loss"] + right["reduction_loss"]),
    }
    total = F.lit(0.0)
    for name, build in parts.items():
        if beta.get(name, 0.0):
            total = total + beta[name] * build()
    return clip01(total)


def prob_or(*values: Column) -> Column:
    """One minus the product of the complements."""
    keep = F.lit(1.0)
    for v in values:
        keep = keep * (1.0 - clip01(v))
    return 1.0 - keep


def severity(gamma: Column) -> Column:
    return F.when(gamma < 0.20, "green").when(gamma < 0.45, "orange").otherwise("red")


# --- interpretability --------------------------------------------------------

def _body(rule: Column) -> Column:
    """Canonical text of a rule body: its conditions sorted by name."""
    entries = F.array_sort(F.map_entries(rule["conditions"]))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), "|")


def interpretability_components(rules: Column, activations: Column, terms: Column) -> dict[str, Column]:
    """Entropy H, rule complexity C, term overlap O and contradiction K of an explanation."""
    n_rules = F.size(rules)
    mean_conditions = array_sum(F.transform(rules, lambda r: F.size(r["conditions"]).cast("double"))) / n_rules
    used = F.flatten(F.transform(rules, lambda r: F.concat(F.map_values(r["conditions"]), F.array(r["conclusion"]))))
    heads = F.array_distinct(
        F.transform(rules, lambda r: F.struct(_body(r).alias("body"), r["conclusion"].alias("conclusion")))
    )

    def contradiction(pairs: Column) -> Column:
        # A body is contradictory when it has more than one distinct conclusion.
        bodies = F.array_distinct(F.transform(pairs, lambda h: h["body"]))
        twice = F.filter(bodies, lambda b: F.size(F.filter(pairs, lambda h: h["body"] == b)) > 1)
        return F.size(twice) / F.size(bodies)

    def overlap(names: Column) -> Column:
        return 1.0 - F.size(F.array_distinct(names)) / F.size(names)

    return {
        "H": F.when(F.size(activations) == 0, 0.0).otherwise(membership_entropy(F.map_values(activations))),
        "C": F.when(n_rules == 0, 0.0).otherwise(clip01(mean_conditions / F.greatest(F.size(terms), F.lit(1)))),
        "O": F.when(n_rules == 0, 0.0).otherwise(clip01(let(used, overlap))),
        "K": F.when(n_rules <= 1, 0.0).otherwise(clip01(let(heads, contradiction))),
    }


def interpretability_loss(H, C, O, K, U, loss, lam: Mapping[str, float] = LAMBDA, lam_delta: float = 0.0) -> Column:
    weighted = lam["H"] * H + lam["C"] * C + lam["O"] * O + lam["K"] * K + lam["U"] * U + lam_delta * loss
    return F.greatest(F.lit(0.0), weighted)


def interpretability_index(loss: Column) -> Column:
    return F.exp(-F.greatest(F.lit(0.0), loss))
