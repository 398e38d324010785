"""Benchmark decontamination: containment search by a prefix filter, verified on exact shingles.

An item of n shingles of which `need` must be in a document keeps its n - need + 1 smallest shingle hashes: if a
document holds `need` of its shingles, it holds one of these, so the search loses nothing. Items are partitioned by size
(powers of two). Each partition has a cut of its own, the largest hash that any of its items keeps, and is probed
with a document's hashes up to that cut only: short items keep most of the range, long ones about a fifth, and neither
changes what the other's partition is probed with. A MinHash of fixed length would miss a short item in a long text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import let
from .common import cut, shingle_hashes, text_print

WIDTH = 5
PERCENT = 80
# A table is broadcast only if it was counted and has no more rows than this (a few MB).
BROADCAST_ROWS = 100_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, otherwise: str | None = None) -> DataFrame:
    """df with a broadcast hint if its rows, counted before, are few; else with the hint `otherwise` for a shuffled join."""
    if df.limit(rows + 1).count() <= rows:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def item_sets(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per distinct text of items: ip (its print), set, n, need is taken by the caller."""
    sets = items.select(text_print(F.col("text")).alias("ip"), F.array_distinct(shingle_hashes(F.col("text"), width)).alias("set"))
    return sets.where(F.size("set") > 0).groupBy("ip").agg(F.any_value("set").alias("set")).withColumn("n", F.size("set"))


def item_sketches(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(part, h, ip): the sketch of each item, in its size partition (powers of two)."""
    need = F.floor((percent * F.col("n") + 99) / 100).cast("int")
    kept = F.slice(F.array_sort("set"), 1, F.col("n") - need + 1)
    return sets.select("ip", F.floor(F.log2("n")).cast("int").alias("part"), F.explode(kept).alias("h"))


def probes(docs: DataFrame, cuts: dict[int, int], width: int = WIDTH) -> DataFrame:
    """(tp, part, h): the shingle hashes of every text once per size partition, up to the cut of the partition.

    cuts has one entry per power of two among the sizes of items, some dozens at most, and becomes a literal.
    """
    parts = F.array(*[F.struct(F.lit(part).alias("part"), F.lit(top).cast("long").alias("top")) for part, top in sorted(cuts.items())])
    below = lambda hs: F.flatten(F.transform(parts, lambda p: F.transform(F.filter(hs, lambda h: h <= p["top"]), lambda h: F.struct(p["part"].alias("part"), h.alias("h")))))
    each = docs.select(text_print(F.col("text")).alias("tp"), F.explode(let(shingle_hashes(F.col("text"), width), below)).alias("p"))
    return each.select("tp", "p.part", "p.h")


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(tp, ip, n_item, n_shared): prints of texts and of the items of which they hold percent or more.

    Equal texts are searched as rows of their own but verified once. An item of fewer words than a
    shingle is one shingle that only an equal text has; null and empty items and texts have none.
    """
    sets = cut(item_sets(items, width))
    sketches = cut(item_sketches(sets, percent))
    cuts = {r.part: r.top for r in sketches.groupBy("part").agg(F.max("h").alias("top")).collect()}  # one per power of two
    if not cuts:
        return docs.sparkSession.createDataFrame([], "tp long, ip long, n_item int, n_shared int")
    pairs = cut(probes(docs, cuts, width).join(bounded(sketches), ["part", "h"]).select("tp", "ip").distinct())
    texts = bounded(pairs.select("tp").distinct(), otherwise="shuffle_hash")
    here = docs.select(text_print(F.col("text")).alias("tp"), F.col("text").alias("body")).join(texts, "tp")
    full = here.select("tp", F.array_distinct(shingle_hashes(F.col("body"), width)).alias("full"))
    shared = F.size(F.array_intersect("full", "set"))
    measured = full.join(bounded(pairs), "tp").join(bounded(sets), "ip").select("tp", "ip", F.col("n").alias("n_item"), shared.alias("n_shared"))
    return measured.where(100 * F.col("n_shared") >= percent * F.col("n_item")).groupBy("tp", "ip", "n_item").agg(F.max("n_shared").alias("n_shared"))


def leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_item, n_shared, containment.

    Rows that repeat a doc_id or an item_id count once, with their best text. Documents without items have no row.
    """
    found = cut(contained_items(docs, items, percent, width))
    named = items.select("item_id", text_print(F.col("text")).alias("ip"))
    hit = docs.select("doc_id", text_print(F.col("text")).alias("tp")).join(bounded(found), "tp").join(bounded(named), "ip")
    best = hit.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_item").cast("long").alias("n_item"), F.col("best.n_shared").cast("long").alias("n_shared"), F.col("best.containment").alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """docs without the rows whose text holds an item. All columns stay as they are."""
    found = cut(contained_items(docs, items, percent, width)).select(F.col("tp").alias("__leaking")).distinct()
    return docs.join(bounded(found, otherwise="shuffle_hash"), text_print(docs["text"]) == F.col("__leaking"), "left_anti")
