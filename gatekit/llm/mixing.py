"""Mixing sources to target weights.

The words of a source form one stream, packed into blocks of fixed length. The mix is a row of output
slots, cut into shards; every slot takes one block. Shard counts per source are multinomial draws given the
totals: all slots are dealt at once by a pseudorandom permutation of the slots that the targets grant, so that
each shard holds a random count per source while the totals are met exactly (free draws would miss them, and
could take a document a fourth time). The k-th slot of a source takes the block that the source's own
pseudorandom permutation puts at k, epoch after epoch, and blocks are joined by source and index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, words

WEIGHTS = (5, 2, 1)
REPEATS = 3
BLOCK_WORDS = 128
SHARD_SLOTS = 8192
SEED = 7
ROUNDS = 24
PRIME = 2147483647
CHUNK = 8192
BUCKET_DIGITS = 3


def round_constants(label: str, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Constants of the rounds of a permutation, from md5."""
    digests = [hashlib.md5(f"{seed}|{label}|{r}".encode()).hexdigest() for r in range(ROUNDS)]
    return [(int(d[:10], 16), 1 + int(d[10:18], 16) % (PRIME - 1), int(d[18:26], 16) % PRIME) for d in digests]


def permuted(x: Column, n: Column, label: str, seed: int = SEED) -> Column:
    """A pseudorandom permutation of 0..n-1, for any n: swap-or-not rounds.

    Every round pairs x with (k - x) mod n and swaps the two or not by a bit that depends on the pair.
    """
    rounds = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for k, a, b in round_constants(label, seed)])

    def step(v: Column, r: Column) -> Column:
        partner = F.pmod(r["k"] - v, n)
        bit = F.pmod(F.pmod(F.greatest(v, partner), F.lit(PRIME)) * r["a"] + r["b"], F.lit(PRIME)) * 2 > PRIME
        return F.when(bit, partner).otherwise(v)

    return F.aggregate(rounds, x.cast("long"), step)


def _key(source: Column) -> Column:
    """Sources as non-null keys in code point order, null last."""
    return F.coalesce(F.concat(F.lit("0"), source), F.lit("1"))


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per source key s: source_size, weight and target, from a table of (s, size).

    Weights repeat over the sources in order. With sources sorted by how soon they reach `repeats` times
    their size, the common level is the largest of (what is left) / (weight left) after each of them.
    The table has one row per source; it is the only one that meets in one task.
    """
    sizes = sized.groupBy("s").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy("s")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", repeats * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    left = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    level = F.max("left").over(everything)
    return ranked.withColumn("left", left).select(
        "s", "source_size", "weight", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target")
    )


def quotas(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """targets plus blocks (of the source), quota (slots it is granted), start (its first) and slots (of all).

    The last block of a source may be short, so a slot counts as the mean length of its blocks. Repeats of
    a block stay within the cap of the target, as the quota is at most that many times the blocks.
    """
    blocks = F.ceil(F.col("source_size") / block_words)
    quota = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0)
    whole = Window.partitionBy(F.lit(0))
    before = whole.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    return targets.withColumn("blocks", blocks).withColumn("quota", quota.cast("long")).withColumns(
        {"start": F.coalesce(F.sum("quota").over(before), F.lit(0)), "slots": F.sum("quota").over(whole)}
    )


def draw_slots(granted: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """One row per output slot: shard, place (in the shard), s, epoch, index (of the block)."""
    partitions = int(granted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = granted.where("quota > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / CHUNK))))
    last = F.least(F.col("quota"), (F.col("chunk") + 1) * CHUNK) - 1
    slots = chunks.repartition(partitions, "s", "chunk").withColumn("k", F.explode(F.sequence(F.col("chunk") * CHUNK, last)))
    dealt = slots.withColumn("slot", permuted(F.col("start") + F.col("k"), F.col("slots"), "deal", seed))
    return dealt.select(
        F.floor(F.col("slot") / shard_slots).alias("shard"),
        F.pmod("slot", F.lit(shard_slots)).alias("place"),
        "s",
        F.floor(F.col("k") / F.col("blocks")).alias("epoch"),
        permuted(F.pmod("k", F.col("blocks")), F.col("blocks"), "blocks", seed).alias("index"),
    )


def shard_counts(slots: DataFrame) -> DataFrame:
    """The draw of every shard: its number of slots per source key."""
    return slots.groupBy("shard", "s").agg(F.count(F.lit(1)).alias("slots"))


def placed(sized: DataFrame) -> DataFrame:
    """sized (d, s, size, ...) plus off: the place of a document's first word in the stream of its source.

    Documents are ordered by a hash bucket of doc_id, then doc_id. Running sums stay inside a bucket, bucket
    totals are summed over at most 16**BUCKET_DIGITS rows per source, so no source meets in one task.
    """
    bucket = F.substring(F.md5(F.coalesce(F.col("d").cast("string"), F.lit(""))), 1, BUCKET_DIGITS)
    rows = sized.withColumn("bucket", bucket)
    inside = Window.partitionBy("s", "bucket").orderBy("d", "size").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("s", "bucket").agg(F.sum("size").alias("in_bucket"))
    bases = totals.select("s", "bucket", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("base"))
    running = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return running.join(bases.hint("merge"), ["s", "bucket"]).withColumn("off", F.col("base") + F.col("inner")).drop("bucket", "base", "inner")


def pieces(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """rows with off and size, once per block they reach into: index, from and upto (words in the document, from 0)."""
    first, last = F.floor(F.col("off") / block_words), F.floor((F.col("off") + F.col("size") - 1) / block_words)
    each = rows.where("size > 0").withColumn("index", F.explode(F.sequence(first, last)))
    return each.withColumns(
        {
            "from": F.greatest(F.lit(0).cast("long"), F.col("index") * block_words - F.col("off")),
            "upto": F.least(F.col("size"), (F.col("index") + 1) * block_words - F.col("off")),
        }
    )


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(F.col("doc_id").alias("d"), _key(F.col("source")).alias("s"), n_words(F.col("text")).alias("size"), *more)


def taken_words(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken, first_shard.

    taken counts the words the mix takes from the document, repeats included; first_shard is the first
    output shard that holds some (null if none). A null source is a source of its own; null and empty texts
    have size 0 and give nothing. Rows that repeat a doc_id are placed one after the other.
    """
    sized = cut(_sized(docs))
    granted = quotas(source_targets(sized, weights, repeats), block_words)
    times = draw_slots(granted, shard_slots, seed).groupBy("s", "index").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("shard"))
    rows = placed(sized)
    counted = (
        pieces(rows.where("size > 0"), block_words)
        .join(times.hint("merge"), ["s", "index"], "left")
        .groupBy("s", "off", "d", "size")
        .agg(F.sum(F.coalesce("times", F.lit(0)) * (F.col("upto") - F.col("from"))).alias("taken"), F.min("shard").alias("first_shard"))
        .select("s", "d", "size", "taken", "first_shard")
    )
    empty = sized.where("size = 0").select("s", "d", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard"))
    return counted.unionByName(empty).join(granted.select("s", "source_size", "target"), "s").select(
        F.col("d").alias("doc_id"), "size", "source_size", "target", "taken", "first_shard"
    )


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, place, source, epoch, index and the text of the packed block, one row per slot.

    Write it with partitionBy or repartitionByRange on shard and place.
    """
    sized = _sized(docs, F.col("source"), F.col("text"))
    granted = quotas(source_targets(sized.select("s", "size"), weights, repeats), block_words)
    part = pieces(placed(sized), block_words).select(
        "s", "index", "source", "off", F.array_join(F.slice(words(F.col("text")), F.col("from").cast("int") + 1, (F.col("upto") - F.col("from")).cast("int")), " ").alias("part")
    )
    packed = part.groupBy("s", "index").agg(
        F.first("source").alias("source"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "part"))), lambda x: x["part"]), " ").alias("text")
    )
    return draw_slots(granted, shard_slots, seed).join(packed, ["s", "index"]).select("shard", "place", "source", "epoch", "index", "text")
