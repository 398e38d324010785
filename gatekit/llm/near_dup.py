"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets and union-find groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import let
from .common import cut, shingle_hashes
from .components import connected_components
from .minhash import sketcher

WIDTH = 5
PERCENT = 85
PLACES = 256
BANDS = 32


def signed(docs: DataFrame, width: int = WIDTH, places: int = PLACES, bands: int = BANDS) -> DataFrame:
    """Per row of docs: doc_id, n (shingles), p1 and p2 (prints of the set), keys (of its bands), brief (a byte per place)."""
    sets = docs.select("doc_id", F.array_distinct(shingle_hashes(F.col("text"), width)).alias("set"))
    return sets.mapInArrow(sketcher(places, bands, 1), "doc_id long, n long, p1 long, p2 long, keys array<long>, brief array<long>")


#: Steps per doubling by which classes of a bucket are ordered, and lots into which those of one step are dealt.
STEPS, LOTS = 8, 16


def numbered(shared: DataFrame) -> DataFrame:
    """shared (bucket, rep, met, ...) with nth, the place of a class in its bucket, from 1; the order is the same in all buckets.

    Those that meet most others come first, in steps of the logarithm, then by lot: a bucket is cut by step and lot, each
    piece is numbered on its own, and pieces are shifted by the sizes of those before, so that no task orders a whole
    bucket.
    """
    step, lot = F.floor(F.log2(F.col("met").cast("double")) * STEPS).cast("int"), F.pmod(F.xxhash64("rep"), F.lit(LOTS)).cast("int")
    pieces = shared.withColumns({"step": step, "lot": lot})
    sizes = pieces.groupBy("bucket", "step", "lot").agg(F.count(F.lit(1)).alias("held"))
    earlier = Window.partitionBy("bucket").orderBy(F.desc("step"), "lot").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("bucket", "step", "lot", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("bucket", "step", "lot").orderBy("rep", "n"))
    place = ["bucket", "step", "lot"]
    return pieces.withColumn("own", own).join(shifts, place).withColumn("nth", F.col("own") + F.col("shift")).drop("own", "shift", "step", "lot", "met")


def _members(rows: DataFrame) -> DataFrame:
    """(bucket, rep, n, brief, keys, home, nth): classes that share a band with another, numbered within the bucket.

    Those that meet most others come first: the text that copies were made from meets nearly all of them. Buckets are
    numbered without signatures and keys, which join afterwards.
    """
    first = rows.where("doc_id = rep").select("rep", "p1", "n", "brief", "keys").dropDuplicates(["rep", "p1"])
    own = first.select("rep", "p1", "n", F.explode("keys").alias("bucket")).distinct()
    sizes = own.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    shared = cut(own.join(sizes.select("bucket", "size"), "bucket"))
    central = shared.groupBy("rep").agg(F.sum("size").alias("met"))
    placed = numbered(shared.join(central, "rep").select("bucket", "rep", "p1", "n", "met"))
    return placed.join(first.select("rep", "p1", "brief", "keys"), ["rep", "p1"]).select("bucket", "rep", "n", "brief", "keys", F.col("rep").alias("home"), "nth")


def places_alike(x: Column, y: Column, places: int) -> Column:
    """In how many places two brief signatures have the same byte."""

    def differing(a: Column, b: Column) -> Column:
        fold4 = lambda t: t.bitwiseOR(F.shiftrightunsigned(t, 4))
        fold2 = lambda t: t.bitwiseOR(F.shiftrightunsigned(t, 2))
        fold1 = lambda t: t.bitwiseOR(F.shiftrightunsigned(t, 1))
        folded = let(let(let(a.bitwiseXOR(b), fold4), fold2), fold1)
        return F.bit_count(folded.bitwiseAND(F.lit(0x0101010101010101)))

    return places - F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda acc, d: acc + d)


def variance_share(places: int, union: int) -> float:
    """Variance of the alike places of two sets with `union` elements in all, as a share of that of plain MinHash."""
    gain = 0.0
    for k in range(1, places):
        at = [math.exp(union * math.log(x / (places - 1))) if x else 0.0 for x in (k - 1, k, k + 1)]
        gain += math.exp(union * math.log(k / places)) * (at[2] + at[0] - 2 * at[1])
    return 1 - gain * (places - 1) / (union - 1)


def least_alike(places: int, percent: int, union: Column) -> Column:
    """Places that a pair at the threshold has alike but for a chance of 2e-4; the more, the smaller its sets."""
    p = percent / 100
    spread = 3.6 * math.sqrt(places * p * (1 - p))
    out = F.lit(math.floor(places * p - spread))
    for most in (2400, 1200, 600, 300, 150) if places > 2 else ():
        out = F.when(union <= most, F.lit(math.floor(places * p - spread * math.sqrt(variance_share(places, most))))).otherwise(out)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough. sets: (node, set)."""
    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    measured = both.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b") - shared).alias("all"))
    return measured.where(100 * F.col("shared") >= percent * F.col("all")).select("a", "b").distinct()


def settle(members: DataFrame, sets: DataFrame, percent: int, links: DataFrame, places: int = PLACES) -> DataFrame:
    """(node, component) of the classes that links tie, links being those given and all that buckets hold.

    members: (bucket, rep, n, brief, keys, home, nth). Classes of one home are not compared; nth puts the members of
    a bucket in an order that is the same in all buckets, from 1. In round t the next 4**t members of each bucket are
    hubs, compared with the members behind them, but only across components: a bucket of copies of one text is
    settled by its first hubs. A pair is compared once, in the smallest bucket it shares by its keys. Buckets leave
    once they lie in one component or each member has been a hub, so no pair of a bucket is left out. Pairs whose
    sizes or brief signatures rule out the threshold are not fetched; the rest is measured on full sets.
    With places=0 members have one key, their bucket, and neither brief nor keys.
    """
    first, hubs, found, groups = 1, 4, links, connected_components(links)
    live = members.withColumn("component", F.col("rep"))
    while True:
        named = live.drop("component").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
        named = named.withColumn("component", F.coalesce("component", "rep"))
        open_ones = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("nth").alias("last"))
        live = cut(named.join(open_ones.where((F.col("low") < F.col("high")) & (F.col("last") > first)).select("bucket"), "bucket"))
        if live.isEmpty():
            return groups
        hub = live.where(F.col("nth").between(first, first + hubs - 1)).select(
            "bucket", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("nth").alias("hub"), F.col("component").alias("ca"), F.col("home").alias("hub_home"),
            *([F.col("brief").alias("hub_brief"), F.col("keys").alias("hub_keys")] if places else []),
        ).withColumnRenamed("bucket", "hub_bucket")
        near = (100 * F.col("na") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("na"))
        apart = (F.col("nth") > F.col("hub")) & (F.col("ca") != F.col("component")) & (F.col("home") != F.col("hub_home"))
        apart = apart & near
        if places:
            apart = apart & (places_alike(F.col("brief"), F.col("hub_brief"), places) >= least_alike(places, percent, (F.col("na") + F.col("n")) * 100 / (100 + percent)))
            apart = apart & (F.array_min(F.array_intersect("keys", "hub_keys")) == F.col("bucket"))
        pairs = live.join(hub, (F.col("bucket") == F.col("hub_bucket")) & apart).select("a", F.col("rep").alias("b")).distinct()
        found = cut(found.union(verified(pairs, sets, percent)))
        groups = connected_components(found)
        first, hubs = first + hubs, hubs * 4


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, places: int = PLACES, bands: int = BANDS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of word shingles (A to Z lower-cased) share `percent` of their union.
    component_id is the smallest doc_id reached, kept tells whether it is the own one. A text of fewer words
    than a shingle is one shingle; null and empty texts have no set and no links. Rows that repeat a doc_id are
    one node with the links of all its texts. A null doc_id takes no part: component_id null, kept true.

    Equal sets are one class and only its smallest doc_id is banded. With the default bands a pair at the
    threshold shares a band with probability 1 - 4e-5, more above it; links are confirmed on full sets.
    """
    rows = cut(signed(docs, width, places, bands))
    able = rows.where("n > 0 AND doc_id IS NOT NULL")
    # Cut, so that the join deals both of its sides anew and can split a class that many rows share.
    classes = cut(able.groupBy("p1", "p2", "n").agg(F.min("doc_id").alias("rep")))
    classed = able.join(classes, ["p1", "p2", "n"]).select("doc_id", "p1", "n", "rep", *[F.when(F.col("doc_id") == F.col("rep"), F.col(c)).alias(c) for c in ("keys", "brief")])
    classed = cut(classed)
    members = cut(_members(classed))
    wanted = members.select(F.col("rep").alias("node")).distinct()
    texts = docs.join(wanted.hint("shuffle_hash"), docs["doc_id"] == wanted["node"]).select("node", "text")
    sets = cut(texts.select("node", F.array_distinct(shingle_hashes(F.col("text"), width)).alias("set")))
    repeats = classed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("doc_id", "a")
    same = classed.join(repeats, "doc_id").select("a", F.col("rep").alias("b")).where("a < b").distinct()
    groups = settle(members, sets, percent, cut(same), places)
    per_class = groups.select(F.col("node").alias("rep"), "component")
    linked = classed.select("doc_id", "n", "rep").join(per_class, "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
