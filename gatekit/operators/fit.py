"""Fitting of disagreement weights from sufficient statistics.

Spark reduces the pairs to one 6x6 moment matrix (per fold); only that reaches the driver.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import double_array, hash_uniform
from ..session import materialised
from .quantiles import average_ranks

FEATURES = ("repr", "rules", "activations", "uncertainty", "trace", "reduction")


def moments(pairs: DataFrame, target: str, features: Sequence[str] = FEATURES, by: Sequence[str] = ()) -> DataFrame:
    """Sums of products of features and target: one partial aggregation."""
    cols = [*features, target]
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(cols) for b in cols[i:]]
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), *sums)


def moment_sums(pairs: DataFrame, target: str = "expert_score", features: Sequence[str] = FEATURES) -> dict[str, float]:
    """The moments of all pairs, for several fits and checks over one scan."""
    return moments(pairs, target, features).first().asDict()


def _unpack(row, features: Sequence[str], target: str):
    def get(a: str, b: str) -> float:
        key = f"{a}*{b}" if f"{a}*{b}" in row else f"{b}*{a}"
        return float(row[key])

    xtx = np.array([[get(a, b) for b in features] for a in features])
    xty = np.array([get(a, target) for a in features])
    return xtx, xty, get(target, target), int(row["n"])


def solve_simplex(xtx: np.ndarray, xty: np.ndarray, n: int, l2: float = 1e-3) -> np.ndarray:
    """The weights on the simplex with the least mean squared error plus l2 times their squares.

    The optimum is the solution of linear equations on the features it uses; with a handful of features every
    choice of them is solved, and the best one without a negative weight is the optimum.
    """
    k = len(xty)
    h, g = 2.0 / n * xtx + 2.0 * l2 * np.eye(k), 2.0 / n * xty
    best, least = np.full(k, 1.0 / k), math.inf
    for size in range(1, k + 1):
        for used in map(list, itertools.combinations(range(k), size)):
            system = np.ones((size + 1, size + 1))
            system[:size, :size], system[size, size] = h[np.ix_(used, used)], 0.0
            part = np.linalg.lstsq(system, np.append(g[used], 1.0), rcond=None)[0][:size]
            if part.min() < -1e-12:
                continue
            w = np.zeros(k)
            w[used] = np.maximum(part, 0.0)
            error = float(w @ h @ w / 2 - g @ w)
            if error < least - 1e-15:
                best, least = w, error
    return best


def fit_beta(pairs: DataFrame, target: str = "expert_score", features: Sequence[str] = FEATURES, l2: float = 1e-3, sums: dict[str, float] | None = None) -> DataFrame:
    """Weights on the simplex that best explain the expert score, as rows (feature, weight). sums: their `moment_sums`, if at hand."""
    row = sums or moment_sums(pairs, target, features)
    if not row["n"]:
        raise ValueError("at least one calibration pair is required")
    xtx, xty, _, n = _unpack(row, features, target)
    w = solve_simplex(xtx, xty, n, l2)
    return pairs.sparkSession.createDataFrame(
        [(f, float(v)) for f, v in zip(features, w)], "feature string, weight double"
    )


def beta_optimality(pairs: DataFrame, weights: DataFrame, target: str = "expert_score", features: Sequence[str] = FEATURES, l2: float = 1e-3, tolerance: float = 1e-4, sums: dict[str, float] | None = None) -> DataFrame:
    """Per feature: weight in [0,1], and its slope the smallest of all where the weight is positive, no smaller where it is zero."""
    xtx, xty, _, n = _unpack(sums or moment_sums(pairs, target, features), features, target)
    fitted = {r.feature: r.weight for r in weights.collect()}
    w = np.array([fitted[f] for f in features])
    slope = 2.0 / n * (xtx @ w - xty) + 2.0 * l2 * w
    level = float(slope @ w)
    rows = [
        (f, bool(-tolerance <= v <= 1 + tolerance), bool(abs(g - level) <= tolerance if v > tolerance else g >= level - tolerance), bool(abs(w.sum() - 1) <= tolerance))
        for f, v, g in zip(features, w, slope, strict=True)
    ]
    return pairs.sparkSession.createDataFrame(rows, "feature string, in_range boolean, optimal boolean, sums_to_one boolean")


def cv_beta(pairs: DataFrame, case: str, target: str = "expert_score", folds: int = 5, seed: int = 42, features: Sequence[str] = FEATURES) -> DataFrame:
    """Per fold: squared error with even and with fitted weights, and rank correlation of the latter.

    Training statistics of a fold are the totals minus its own, so the pairs are read once for the
    fit. Ranks are averaged over ties and correlated from counts of distinct value pairs. The pairs are computed once and
    stored as numbers, for the fit and the ranks read them time and again.
    """
    fold = F.floor(hash_uniform(seed, F.col(case)) * folds).cast("int").alias("fold")
    tagged = materialised(pairs.select(fold, *features, target))
    stats = {r["fold"]: _unpack(r.asDict(), features, target) for r in moments(tagged, target, features, ["fold"]).collect()}
    total = [sum(s[i] for s in stats.values()) for i in range(4)]
    even = np.full(len(features), 1.0 / len(features))
    rows, fitted = [], {}
    for fold, (xtx, xty, yty, n) in sorted(stats.items()):
        w = solve_simplex(total[0] - xtx, total[1] - xty, total[3] - n)
        fitted[fold] = w

        def mse(v: np.ndarray) -> float:
            return float((yty - 2 * v @ xty + v @ xtx @ v) / n)

        rows.append((fold, int(total[3] - n), n, mse(even), mse(w)))
    errors = pairs.sparkSession.createDataFrame(
        rows, "fold int, n_train long, n_test long, mse_base double, mse_calibrated double"
    )
    # Weights are looked up by fold, so each feature appears once in the expression.
    prediction = F.lit(0.0)
    for i, f in enumerate(features):
        by_fold = double_array([fitted[k][i] if k in fitted else 0.0 for k in range(folds)])
        prediction = prediction + F.col(f) * F.get(by_fold, F.col("fold"))
    scored = tagged.select("fold", F.col(target).alias("a"), prediction.alias("b"))
    return errors.join(spearman(scored, "a", "b", ["fold"]), "fold")


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str]) -> DataFrame:
    """Rank correlation per key with averaged ties, from distinct value pairs. Values must not be null.

    Ranks are centred before their squares are summed, so that no digits are lost on long tables.
    """
    # Join keys that cannot be null, so that no null test on them is pushed below the aggregation.
    va, vb = (F.coalesce(F.col(c), F.lit(float("nan"))) for c in (a, b))
    cells = materialised(df.groupBy(*keys, va.alias("va"), vb.alias("vb")).agg(F.count("*").alias("n")))
    ranks = {}
    for name in ("va", "vb"):
        counts = materialised(cells.groupBy(*keys, F.col(name).alias("value")).agg(F.sum("n").alias("n")))
        ranks[name] = average_ranks(counts, keys).select(
            *keys, F.col("value").alias(name), (F.col("rank") - (F.col("all_n") + 1) / 2.0).alias(f"r{name}")
        )
    joined = cells.join(ranks["va"], [*keys, "va"]).join(ranks["vb"], [*keys, "vb"])
    n, x, y = F.col("n"), F.col("rva"), F.col("rvb")
    s = {k: F.sum(v) for k, v in {"n": n, "x": n * x, "y": n * y, "xx": n * x * x, "yy": n * y * y, "xy": n * x * y}.items()}
    sums = joined.groupBy(*keys).agg(*[v.alias(f"s_{k}") for k, v in s.items()])
    g = {k: F.col(f"s_{k}") for k in s}
    var_x, var_y = g["xx"] - g["x"] * g["x"] / g["n"], g["yy"] - g["y"] * g["y"] / g["n"]
    cov = g["xy"] - g["x"] * g["y"] / g["n"]
    return sums.select(
        *keys, F.when((var_x <= 0) | (var_y <= 0), 0.0).otherwise(cov / F.sqrt(var_x * var_y)).alias("spearman")
    )
