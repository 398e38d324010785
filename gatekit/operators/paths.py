"""Ordered edges and events: certification of paths and drift between neighbours."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.disagreement import semantic_disagreement
from ..plans.plan import BETA


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Column, bucket: Column, out: str = "prev") -> DataFrame:
    """Previous row's payload per key, like lag, but a long key is split into buckets.

    `bucket` must rise with the order (a day, a block of sequence numbers). The window runs per
    (key, bucket); the first row of a bucket takes the last payload of the key's earlier bucket
    from a summary with one row per bucket. A key with a third of all rows becomes many tasks.
    """
    base = df.withColumn("_bucket", bucket).withColumn("_payload", payload)
    position = F.struct(*order)
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    marked = base.withColumn("_lag", F.lag("_payload").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    tails = base.groupBy(*keys, "_bucket").agg(F.max_by("_payload", position).alias("_tail"))
    carry = tails.select(
        *keys, "_bucket", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry")
    )
    # Null keys and buckets are keys like others.
    names = [*keys, "_bucket"]
    ends = carry.select(*[F.col(c).alias(f"_of_{c}") for c in names], "_carry")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in names]
    joined = marked.join(ends, reduce(lambda a, b: a & b, same)).drop(*[f"_of_{c}" for c in names])
    return joined.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))).drop(
        "_bucket", "_payload", "_lag", "_first", "_carry"
    )


def edge_diagnostics(gamma: Column, gamma_max: Column, passed: Column, diagnostics: Column) -> Column:
    """Diagnostics of one edge with the default codes added."""
    too_far = gamma > gamma_max
    base = F.when(too_far & ~F.array_contains(diagnostics, "gamma_exceeded"), F.array_append(diagnostics, "gamma_exceeded"))
    filled = base.otherwise(diagnostics)
    return F.when((~passed | too_far) & (F.size(filled) == 0), F.array(F.lit("uncertified_edge"))).otherwise(filled)


def certify_paths(edges: DataFrame, path: str = "path_id", order: Sequence[str] = ("seq",), bucket: Column | None = None) -> DataFrame:
    """Verdict per path from its ordered edges.

    Edges carry source, target, gamma, gamma_max, passed and diagnostics. A path is broken by a
    failed edge, an edge over its limit or an edge that does not start where the one before ends.
    Diagnostics are the distinct codes in order of first appearance.
    """
    bucket = F.lit(0) if bucket is None else bucket
    linked = with_previous(edges, [path], order, F.col("target"), bucket, "prev_target")
    mismatch = F.col("prev_target").isNotNull() & (F.col("prev_target") != F.col("source"))
    codes = edge_diagnostics(F.col("gamma"), F.col("gamma_max"), F.col("passed"), F.col("diagnostics"))
    position = F.struct(*order)
    checked = linked.select(
        path,
        position.alias("position"),
        "source",
        "target",
        mismatch.alias("mismatch"),
        (~F.col("passed") | (F.col("gamma") > F.col("gamma_max"))).alias("failed"),
        F.when(mismatch, F.array_append(codes, "path_endpoint_mismatch")).otherwise(codes).alias("codes"),
    )
    totals = checked.groupBy(path).agg(
        F.min_by("source", "position").alias("source"),
        F.max_by("target", "position").alias("target"),
        F.count("*").alias("n_edges"),
        F.count_if("mismatch").alias("n_mismatch"),
        F.bool_or(F.col("failed") | F.col("mismatch")).alias("rupture"),
    )
    # First position per code: one row per path and code before anything is collected.
    first_seen = (
        checked.select(path, "position", F.posexplode("codes").alias("at", "code"))
        .groupBy(path, "code")
        .agg(F.min(F.struct("position", "at")).alias("first_at"))
    )
    listed = first_seen.groupBy(path).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first_at", "code"))), lambda s: s["code"]).alias("diagnostics")
    )
    out = totals.join(listed, path, "left")
    diagnostics = F.coalesce(F.col("diagnostics"), F.array().cast("array<string>"))
    critical = F.exists(diagnostics, lambda d: F.lower(d).contains("crit"))
    return out.select(
        path, "source", "target", "n_edges", "n_mismatch", "rupture",
        (~F.col("rupture")).alias("certified"),
        (F.col("rupture") | critical).alias("rupture_inhabited"),
        diagnostics.alias("diagnostics"),
    )


def path_certificates(edges: DataFrame, gamma_max: float | None = None, path: str = "path_id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Length, endpoints and capped totals per path: one aggregation with map-side combine."""
    position = F.struct(*order)
    totals = edges.groupBy(path).agg(
        F.min_by("source", position).alias("source"),
        F.max_by("target", position).alias("target"),
        F.count("*").alias("length"),
        F.least(F.lit(1.0), F.sum("gamma")).alias("gamma_total"),
        F.least(F.lit(1.0), F.sum("delta")).alias("delta_total"),
    )
    within = F.col("gamma_total") <= gamma_max if gamma_max is not None else F.lit(True)
    return totals.withColumn("valid", within)


def drift_edges(events: DataFrame, entity: str, order: Sequence[str], bucket: Column, parts: Sequence[str], beta: Mapping[str, float] = BETA, gamma_max: float = 0.25) -> DataFrame:
    """Disagreement of each explanation with the entity's one before; rupture when above gamma_max."""
    payload = F.struct(*parts)
    linked = with_previous(events, [entity], order, payload, bucket, "prev").where(F.col("prev").isNotNull())
    gamma = semantic_disagreement(
        {p: F.col("prev")[p] for p in parts}, {p: F.col(p) for p in parts}, beta
    )
    return linked.withColumn("gamma", gamma).withColumn("rupture", F.col("gamma") > gamma_max)


def drift_path(edges: DataFrame, entity: str) -> DataFrame:
    return edges.groupBy(entity).agg(
        F.count("*").alias("n_edges"),
        F.count_if("rupture").alias("n_ruptures"),
        F.max("gamma").alias("max_gamma"),
        (F.count_if("rupture") == 0).alias("is_continuous"),
    )
