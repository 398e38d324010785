"""Exact order statistics without a global sort or an unbounded group.

Quantiles count rows by order-preserving buckets and look only into the buckets of the wanted ranks, which takes two
scans. Prefix sums cut distinct values at split points that a sketch gives. Only totals are added up globally;
windows run inside a bucket or a part of one, where Spark sorts and spills.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import let
from ..session import materialised

_BEFORE = (Window.unboundedPreceding, -1)
# Buckets per key.
SPLITS = 64


def _bucketed(df: DataFrame, keys: Sequence[str], splits: int = SPLITS) -> DataFrame:
    """df (keys, value, ...) plus bucket: how many split points of its key lie at or below the value.

    The split points are quantiles of a bounded sketch of the data itself, so buckets are alike in size whatever the
    scale of the values; equal values share a bucket, and infinities fall into the outermost ones.
    """
    finite = F.when(F.abs("value") != F.lit(float("inf")), F.col("value"))
    shares = [i / splits for i in range(1, splits)]
    points = F.coalesce(F.percentile_approx(finite, shares, 10 * splits), F.array().cast("array<double>")).alias("_points")
    if keys:
        table = df.groupBy(*keys).agg(points)
        own = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
        same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
        with_points = df.join(table.select(*own, "_points"), reduce(lambda a, b: a & b, same)).drop(*[f"_key_{i}" for i in range(len(keys))])
    else:
        with_points = df.withColumn("_points", df.agg(points).scalar())
    below = let(F.col("value"), lambda v: F.size(F.filter("_points", lambda p: p <= v)))
    return with_points.withColumn("bucket", below).drop("_points")


def _bucket_offsets(bucketed: DataFrame, measures: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Totals per bucket and the sum of all earlier buckets. At most SPLITS rows per key."""
    totals = bucketed.groupBy(*keys, "bucket").agg(*[F.sum(m).alias(f"in_{m}") for m in measures])
    w = Window.partitionBy(*keys).orderBy("bucket")
    whole = Window.partitionBy(*keys)
    return totals.select(
        *keys,
        "bucket",
        *[f"in_{m}" for m in measures],
        *[F.coalesce(F.sum(f"in_{m}").over(w.rowsBetween(*_BEFORE)), F.lit(0)).alias(f"off_{m}") for m in measures],
        *[F.sum(f"in_{m}").over(whole).alias(f"all_{m}") for m in measures],
    )


def _beside(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Equi-join on names where null equals null; the columns of names are kept once."""
    own = right.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(names)], *[c for c in right.columns if c not in names])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(names)]
    return left.join(own, reduce(lambda a, b: a & b, same)).drop(*[f"_of_{i}" for i in range(len(names))])


def prefix_totals(distinct: DataFrame, measures: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add before_<m> (sum over smaller values) and all_<m> to a table of distinct values."""
    bucketed = _bucketed(distinct, keys)
    offsets = _bucket_offsets(bucketed, measures, keys)
    w = Window.partitionBy(*keys, "bucket").orderBy("value").rowsBetween(*_BEFORE)
    inner = bucketed.select("*", *[F.coalesce(F.sum(m).over(w), F.lit(0)).alias(f"inner_{m}") for m in measures])
    joined = _beside(inner, offsets.drop(*[f"in_{m}" for m in measures]), [*keys, "bucket"])
    return joined.select(
        *keys,
        "value",
        *[c for c in distinct.columns if c not in (*keys, "value")],
        *[(F.col(f"inner_{m}") + F.col(f"off_{m}")).alias(f"before_{m}") for m in measures],
        *[f"all_{m}" for m in measures],
    )


def _rank(q: float, n: Column) -> Column:
    return (n - 1) * F.lit(float(q))


#: Buckets per power of two, and parts into which a bucket that holds a wanted rank is cut again.
PER_OCTAVE = 4096
PARTS = 1024
_MISSING, _LARGEST = -(1 << 62), 1 << 40


def order_bucket(value: Column) -> Column:
    """A whole number that never falls as the value grows: the sign and the power of two, in PER_OCTAVE steps.

    Null and NaN get a bucket of their own below all others. Values so small that they have no full precision still
    have a positive place, and infinities lie outside of all finite values.
    """
    size = F.abs(value)
    place = F.floor(F.least((F.log2(size) + 1080.0) * float(PER_OCTAVE), F.lit(float(_LARGEST)))) + 1
    return F.when(value.isNull() | F.isnan(value), _MISSING).when(value > 0, place).when(value < 0, -place).otherwise(0).cast("long")


def _histogram(rows: DataFrame, keys: Sequence[str], moments: bool) -> DataFrame:
    """Buckets of each key with in_n rows, off_n rows in lower ones, all_n in all, lo and hi; with moments, mean and std of the key.

    Tasks count their own rows; what is shuffled and put in order are buckets, which do not grow with the rows.
    """
    per_bucket = [F.count(F.lit(1)).alias("rows"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    if moments:
        per_bucket += [F.avg("value").alias("center"), F.var_pop("value").alias("spread")]
    counted = rows.groupBy(*keys, "bucket").agg(*per_bucket)
    n = F.when(F.col("bucket") == _MISSING, 0).otherwise(F.col("rows"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("in_n").over(whole.orderBy("bucket").rowsBetween(*_BEFORE)), F.lit(0))
    out = counted.withColumn("in_n", n).select("*", before.alias("off_n"), F.sum("in_n").over(whole).alias("all_n"))
    if moments:
        held = F.col("in_n") > 0
        out = out.withColumn("mean", F.sum(F.when(held, F.col("in_n") * F.col("center"))).over(whole) / F.col("all_n"))
        off = F.col("center") - F.col("mean")
        squares = F.sum(F.when(held, F.col("in_n") * (F.col("spread") + off * off))).over(whole)
        out = out.withColumn("std", F.sqrt(squares / F.col("all_n")))
    return out


def _around(df: DataFrame, value: str, keys: Sequence[str], wanted: Column, few_keys: bool = False, moments: bool = False, stored: bool = False) -> DataFrame:
    """(keys, value, n, first_rank, all_n) of the values in the buckets where `wanted`, over off_n, in_n and all_n, holds.

    One scan counts buckets, a second one takes the values of the buckets that hold a wanted rank, counted in the
    tasks. These buckets are cut again into parts between their smallest and largest value, and only parts that hold
    a wanted rank are put in order, so that no task orders a whole bucket. stored: the wanted buckets become a table, so that
    the plan knows their size and rows meet them without a shuffle where keys are few.
    """
    carried = ["mean", "std"] if moments else []
    rows = df.select(*keys, F.col(value).cast("double").alias("value"))
    rows = rows.select("*", order_bucket(F.col("value")).alias("bucket"))
    offsets = _histogram(rows, keys, moments).where(wanted).select(*keys, "bucket", "off_n", "all_n", "lo", "hi", *carried)
    if stored:
        offsets = materialised(offsets)
    # A key has two wanted buckets per rank, so without keys, or with keys that the plan lists, the table is small.
    near = _beside(rows, F.broadcast(offsets) if few_keys or not keys else offsets, [*keys, "bucket"])
    place = [*keys, "bucket", "off_n", "all_n", "lo", "hi", *carried]
    counts = near.groupBy(*place, "value").agg(F.count(F.lit(1)).alias("n"))
    step = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * float(PARTS - 1)
    split = (F.col("hi") > F.col("lo")) & (F.abs("lo") < F.lit(math.inf)) & (F.abs("hi") < F.lit(math.inf))
    parts = counts.withColumn("part", F.when(split, F.floor(step)).otherwise(0).cast("int"))
    totals = parts.groupBy(*place, "part").agg(F.sum("n").alias("in_n"))
    earlier = F.coalesce(F.sum("in_n").over(Window.partitionBy(*keys, "bucket").orderBy("part").rowsBetween(*_BEFORE)), F.lit(0))
    held = totals.select(*keys, "bucket", "part", "in_n", (F.col("off_n") + earlier).alias("off_n"), "all_n").where(wanted).drop("in_n", "all_n")
    chosen = _beside(parts.drop("off_n"), F.broadcast(held) if few_keys or not keys else held, [*keys, "bucket", "part"])
    w = Window.partitionBy(*keys, "bucket", "part").orderBy("value").rowsBetween(*_BEFORE)
    return chosen.select(*keys, "value", "n", "all_n", *carried, (F.coalesce(F.sum("n").over(w), F.lit(0)) + F.col("off_n")).alias("first_rank"))


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), few_keys: bool = False, moments: bool = False) -> DataFrame:
    """Linearly interpolated quantiles: one row per key, one column per named probability. Nulls and NaN are left out.

    few_keys: the keys come from a list in the plan, such as column names. moments adds mean and population deviation.
    """
    wanted = F.lit(False)
    for q in probs.values():
        h = _rank(q, F.col("all_n"))
        wanted = wanted | ((F.col("off_n") <= F.ceil(h)) & (F.floor(h) < F.col("off_n") + F.col("in_n")))
    ranked = _around(df, value, keys, wanted, few_keys, moments).withColumn("last_rank", F.col("first_rank") + F.col("n") - 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first_rank") <= rank) & (rank <= F.col("last_rank")), F.col("value")))

    extra = ["mean", "std"] if moments else []
    aggs = [F.max("all_n").alias("n_values"), *[F.max(c).alias(c) for c in extra]]
    for name, q in probs.items():
        h = _rank(q, F.col("all_n"))
        aggs += [at(F.floor(h)).alias(f"lo_{name}"), at(F.ceil(h)).alias(f"hi_{name}")]
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        "n_values",
        *extra,
        *[
            F.when(F.col(f"lo_{name}") == F.col(f"hi_{name}"), F.col(f"lo_{name}")).otherwise(
                F.col(f"lo_{name}")
                + (F.col(f"hi_{name}") - F.col(f"lo_{name}"))
                * (_rank(q, F.col("n_values")) - F.floor(_rank(q, F.col("n_values"))))
            ).alias(name)
            for name, q in probs.items()
        ],
    )


def unpivot(df: DataFrame, columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """Long form (column, value) of numeric columns; a projection plus explode, no shuffle."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("double").alias(value)) for c in columns]
    )
    return df.select(F.inline(pairs))


def average_ranks(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value from its count."""
    ranked = prefix_totals(counts, ["n"], keys)
    return ranked.withColumn("rank", F.col("before_n") + (F.col("n") + 1) / 2.0)


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve with ties averaged; null when a class is missing."""
    per_score = df.groupBy(F.col(score).cast("double").alias("value")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
    )
    ranked = prefix_totals(per_score, ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2.0))
    n_pos, n_neg = F.max("all_pos"), F.max("all_neg")
    return ranked.agg(F.when((n_pos > 0) & (n_neg > 0), wins / (n_pos.cast("double") * n_neg)).alias("roc_auc"))


def cut_points(df: DataFrame, rank_value: str, shares: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Value below which the given shares of each group fall, as columns cut_0, cut_1, ..."""
    wanted = F.lit(False)
    for s in shares:
        target = F.ceil(F.col("all_n") * F.lit(s))
        wanted = wanted | ((F.col("off_n") <= target) & (target < F.col("off_n") + F.col("in_n")))
    ranked = _around(df, rank_value, keys, wanted, stored=bool(keys))
    cuts = []
    for i, s in enumerate(shares):
        target = F.ceil(F.col("all_n") * F.lit(s))
        hit = (F.col("first_rank") <= target) & (target < F.col("first_rank") + F.col("n"))
        cuts.append(F.coalesce(F.max(F.when(hit, F.col("value"))), F.lit(math.inf)).alias(f"cut_{i}"))
    return ranked.groupBy(*keys).agg(*cuts)
