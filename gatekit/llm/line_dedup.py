"""Line dedup: repeated lines go, except in the largest document that holds them.

Hashes of long lines are counted per slice of documents, range-partitioned and sorted by document and
position, so that the first row of a key streams by with the totals of its slices. What comes back per
document is a bitmap of kept lines, compressed to its runs of ones; the text is cut by runs only where
a document has such a bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import let
from .common import ascii_lower, cut, lines, strip, text_print

MIN_CHARS = 40
MIN_DOCS = 5
SLICES = 64


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line with a long key: d, fp (print of the text), n (lines of the document), pos, h1, h2.

    Two independent hashes make 96 bits, so equal hashes mean equal keys at any realistic size.
    """
    split = docs.select(
        F.col("doc_id").alias("d"), text_print(F.col("text")).alias("fp"), lines(F.col("text")).alias("ls")
    )
    each = split.select("d", "fp", F.size("ls").alias("n"), F.posexplode("ls").alias("pos", "line"))
    keyed = each.select("d", "fp", "n", "pos", strip(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    key = ascii_lower(F.col("key"))
    return keyed.select("d", "fp", "n", "pos", F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def repeated_lines(hashes: DataFrame, min_docs: int = MIN_DOCS, slices: int = SLICES) -> DataFrame:
    """Keys in at least min_docs documents with the largest document, keep.

    A line that half of all documents hold is `slices` rows after pre-aggregation.
    """
    per_doc = hashes.groupBy("h1", "h2", "d").agg(F.min("pos").alias("pos"))
    place = F.pmod(F.xxhash64("d"), F.lit(slices))
    per_slice = per_doc.groupBy("h1", "h2", place.alias("slice")).agg(
        F.count(F.lit(1)).alias("docs"), F.max("d").alias("d"), F.max_by("pos", "d").alias("pos")
    )
    ranged = per_slice.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc("d"), "pos")
    key = Window.partitionBy("h1", "h2")
    first = key.orderBy(F.desc("d"), "pos")
    streamed = ranged.select(
        "h1", "h2", "d", F.row_number().over(first).alias("nth"), F.sum("docs").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("docs")
    )
    return streamed.where((F.col("nth") == 1) & (F.col("docs") >= min_docs)).select("h1", "h2", F.col("d").alias("keep"))


def _runs(dropped: Column, n: Column) -> Column:
    """Runs of kept lines between sorted dropped positions: (first line counted from 1, number)."""
    ends = F.concat(dropped, F.array(n))
    run = F.transform(
        ends,
        lambda end, i: let(
            F.coalesce(F.get(dropped, i - 1), F.lit(-1)),
            lambda before: F.struct((before + 2).alias("first"), (end - before - 1).alias("len")),
        ),
    )
    return F.filter(run, lambda r: r["len"] > 0)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Documents that lose lines: d, fp, dropped (their number), runs (ones of the keep bitmap).

    Rows that repeat a doc_id are one document, but each text has its own bitmap. Null counts as one doc_id.
    """
    hashes = cut(line_hashes(docs, min_chars))
    hit = hashes.join(repeated_lines(hashes, min_docs), ["h1", "h2"]).where(~F.col("d").eqNullSafe(F.col("keep")))
    gone = hit.groupBy("d", "fp").agg(F.array_sort(F.collect_set("pos")).alias("gone"), F.max("n").alias("n"))
    return gone.select("d", "fp", F.size("gone").alias("dropped"), _runs(F.col("gone"), F.col("n")).alias("runs"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with `text` cut to its kept lines, plus n_lines and n_dropped; all other columns stay.

    A key is a line stripped at both ends with A to Z lower-cased. Keys of at least min_chars code points
    in at least min_docs documents lose all their lines but those in the largest doc_id. Null and empty texts
    are one empty line, which is never dropped; they come back as empty texts. A document that loses every
    line stays, with an empty text.
    """
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    maps = keep_bitmaps(docs, min_chars, min_docs).hint("shuffle_hash").alias("m")
    here = docs.select(*[F.col(f"`{c}`") for c in own], F.coalesce("text", F.lit("")).alias("text")).alias("t")
    match = F.col("t.doc_id").eqNullSafe(F.col("m.d")) & (text_print(F.col("t.text")) == F.col("m.fp"))
    cut_text = F.array_join(
        F.flatten(let(lines(F.col("t.text")), lambda ls: F.transform(F.col("m.runs"), lambda r: F.slice(ls, r["first"], r["len"])))), "\n"
    )
    return here.join(maps, match, "left").select(
        *[F.col(f"t.`{c}`") for c in own],
        F.when(F.col("m.runs").isNull(), F.col("t.text")).otherwise(cut_text).alias("text"),
        F.size(lines(F.col("t.text"))).cast("long").alias("n_lines"),
        F.coalesce("m.dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
