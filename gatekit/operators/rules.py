"""Importance of additive rules by leaving one out.

Cases carry their rule activations as an array h, one entry per rule; weights theta are a small
literal array. The full logit is computed once per row and each rule is removed by subtraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import double_array, hash_uniform, poisson1


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    den = 2 * tp + fp + fn
    return F.when(den == 0, 0.0).otherwise(2 * tp / den)


def logits(h: Column, theta: Column, bias: float = 0.0) -> Column:
    return F.aggregate(F.zip_with(h, theta, lambda a, b: a * b), F.lit(float(bias)), lambda acc, v: acc + v)


def _scored(df: DataFrame, h: str, theta: Sequence[float], bias: float) -> DataFrame:
    return df.withColumn("_theta", double_array(theta)).withColumn("_z", logits(F.col(h), F.col("_theta"), bias))


def rule_importance_lofo(df: DataFrame, theta: Sequence[float], h: str = "h", y: str = "y", bias: float = 0.0, threshold: float = 0.0, weight: str | None = None) -> DataFrame:
    """F1 with and without each rule. One explode and one partial aggregation of counters."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    scored = _scored(df, h, theta, bias)
    parts = F.zip_with(h, "_theta", lambda a, b: F.struct(a.alias("h"), (a * b).alias("part")))
    rows = scored.select(
        (F.col(y) == 1).alias("t"), (F.col("_z") >= threshold).alias("full"), F.col("_z").alias("z"), w.alias("w"),
        F.posexplode(parts).alias("rule", "r"),
    ).withColumn("without", F.col("z") - F.col("r.part") >= threshold)

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("w")).otherwise(0.0))

    t = F.col("t")
    agg = rows.groupBy("rule").agg(
        *[
            total(cond).alias(f"{name}_{which}")
            for which in ("full", "without")
            for name, cond in {
                "tp": t & F.col(which), "fp": ~t & F.col(which), "fn": t & ~F.col(which),
            }.items()
        ],
        F.avg(F.abs("r.h")).alias("mean_abs_activation"),
    )
    theta_at = F.get(double_array(theta), F.col("rule"))
    return agg.select(
        F.col("rule").cast("long").alias("rule"),
        f1(F.col("tp_full"), F.col("fp_full"), F.col("fn_full")).alias("baseline_f1"),
        f1(F.col("tp_without"), F.col("fp_without"), F.col("fn_without")).alias("f1_without"),
        theta_at.alias("theta"),
        "mean_abs_activation",
    ).withColumn("delta_f1", F.col("baseline_f1") - F.col("f1_without"))


def top_rules(importance: DataFrame, budget: int) -> DataFrame:
    if budget < 0:
        raise ValueError("budget must be non-negative")
    return importance.orderBy(F.round("delta_f1", 12).desc(), F.col("mean_abs_activation").desc(), "rule").limit(budget)


def rule_importance_magnitude(df: DataFrame, theta: Sequence[float], h: str = "h") -> DataFrame:
    """|theta| times mean absolute activation per rule."""
    rows = df.select(F.posexplode(h).alias("rule", "h"))
    means = rows.groupBy("rule").agg(F.avg(F.abs("h")).alias("mean_abs_activation"))
    return means.select(
        F.col("rule").cast("long").alias("rule"),
        "mean_abs_activation",
        (F.abs(F.get(double_array(theta), F.col("rule"))) * F.col("mean_abs_activation")).alias("magnitude"),
    )


def top_magnitude(importance: DataFrame, budget: int) -> DataFrame:
    return importance.orderBy(F.col("magnitude").desc(), "rule").limit(budget)


def _moments(replicates: int, n_rules: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (cell, flips, activations, draws) to one row of weighted moments per replicate, rule and task.

    Draws are a rows x replicates matrix, activations and flips are rows x rules; their products are the moments, so
    what a task holds and hands on does not depend on its rows. Defined inside, so that Spark ships it by value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros((4, replicates, n_rules))
        held, cells = np.zeros((replicates, n_rules)), np.zeros((4, replicates))
        for batch in batches:
            n = batch.num_rows
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            flat = lambda name, width, kind: batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, width)  # noqa: B023, E731
            draws, activations = flat("draws", replicates, float), flat("activations", n_rules, float)
            flips = flat("flips", n_rules, float)
            held += draws.T @ activations
            for k in range(4):
                mine = cell == k
                cells[k] += draws[mine].sum(axis=0)
                moved[k] += draws[mine].T @ flips[mine]
        rep, rule = (x.ravel() for x in np.indices((replicates, n_rules)))
        columns = [rep.astype(np.int64), rule.astype(np.int64), held.ravel(), *(m.ravel() for m in moved), *(np.repeat(c, n_rules) for c in cells)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "rule", "held", *[f"moved_{k}" for k in range(4)], *[f"cell_{k}" for k in range(4)]])

    return run


def rule_importance_bootstrap(df: DataFrame, theta: Sequence[float], case: str, h: str = "h", y: str = "y", bias: float = 0.0, threshold: float = 0.0, replicates: int = 50, top_k: int | None = None, seed: int = 42) -> DataFrame:
    """Mean and spread of the F1 drop, top-k frequency and mean rank over bootstrap replicates.

    A row's weight in a replicate is a Poisson(1) draw from the replicate and `case`. Equal drops are ranked by the mean
    absolute activation within the replicate, then by rule. Tasks multiply draws with activations and flips in blocks
    and hand on replicates x rules sums, whatever number of rows they saw.
    """
    n_rules = len(theta)
    top = max(1, min(n_rules, round(0.10 * n_rules) if top_k is None else top_k))
    t, full = F.col(y) == 1, F.col("_z") >= threshold
    flips = F.transform(F.zip_with(h, "_theta", lambda a, b: a * b), lambda part: ((F.col("_z") - part >= threshold) != full).cast("double"))
    draws = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda rep: poisson1(hash_uniform(seed, rep, F.col(case))))
    # Cells of the confusion table: 0 true positive, 1 false positive, 2 false negative, 3 true negative.
    cell = F.when(t & full, 0).when(full, 1).when(t, 2).otherwise(3)
    rows = _scored(df, h, theta, bias).select(cell.alias("cell"), flips.alias("flips"), F.transform(h, F.abs).alias("activations"), draws.alias("draws"))
    sums = [*[f"moved_{k}" for k in range(4)], *[f"cell_{k}" for k in range(4)]]
    per_task = rows.mapInArrow(_moments(replicates, n_rules), "rep long, rule long, held double, " + ", ".join(f"{c} double" for c in sums))
    total = per_task.groupBy("rep", "rule").agg(*[F.sum(c).alias(c) for c in ("held", *sums)])
    tp, fp, fn, tn = (F.col(f"cell_{k}") for k in range(4))
    # A flip moves a case out of its cell of the confusion table and into the opposite one.
    out_tp, out_fp, out_fn, out_tn = (F.col(f"moved_{k}") for k in range(4))
    without = f1(tp - out_tp + out_fn, fp - out_fp + out_tn, fn - out_fn + out_tp)
    drops = total.select("rep", "rule", (f1(tp, fp, fn) - without).alias("delta_f1"), (F.col("held") / F.greatest(F.lit(1.0), tp + fp + fn + tn)).alias("mean_abs_activation"))
    w = Window.partitionBy("rep").orderBy(F.round("delta_f1", 12).desc(), F.round("mean_abs_activation", 12).desc(), "rule")
    ranked = drops.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy("rule").agg(
        F.avg("delta_f1").alias("mean_delta_f1"),
        F.stddev_pop("delta_f1").alias("std_delta_f1"),
        F.avg((F.col("rank") <= top).cast("double")).alias("top_frequency"),
        F.avg(F.col("rank").cast("double")).alias("mean_rank"),
    )


def top_bootstrap(importance: DataFrame, budget: int) -> DataFrame:
    """The rules most often in the top, then by mean drop, mean rank and rule."""
    return importance.orderBy(F.col("top_frequency").desc(), F.round("mean_delta_f1", 12).desc(), "mean_rank", "rule").limit(budget)


def subset_f1(df: DataFrame, theta: Sequence[float], chosen: DataFrame, h: str = "h", y: str = "y", bias: float = 0.0, threshold: float = 0.0) -> DataFrame:
    """F1 of the model reduced to the chosen rules; their ids come by scalar subquery."""
    kept = chosen.agg(F.collect_list(F.col("rule").cast("int"))).scalar()
    theta_col = double_array(theta)
    scored = df.withColumn("_kept", kept).withColumn("_theta", theta_col)
    masked = F.zip_with(h, "_theta", lambda a, b: a * b)
    z = F.aggregate(
        F.zip_with(masked, F.sequence(F.lit(0), F.lit(len(theta) - 1)), lambda part, r: F.when(F.array_contains("_kept", r), part).otherwise(0.0)),
        F.lit(float(bias)),
        lambda acc, v: acc + v,
    )
    pred, t = z >= threshold, F.col(y) == 1
    return scored.select(t.alias("t"), pred.alias("q")).agg(
        f1(F.count_if(F.col("t") & F.col("q")), F.count_if(~F.col("t") & F.col("q")), F.count_if(F.col("t") & ~F.col("q"))).alias("f1")
    )


def set_jaccard(left: DataFrame, right: DataFrame, key: str = "rule") -> DataFrame:
    """Jaccard similarity of two id sets, 1 for two empty ones."""
    tagged = left.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        right.select(key, F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    per_key = tagged.groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return per_key.agg(
        F.when(F.count("*") == 0, 1.0).otherwise(F.count_if((F.col("a") == 1) & (F.col("b") == 1)) / F.count("*")).alias("jaccard")
    )
