"""Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups, a proof per row.

Leaves are ranked by range partitions and gathered in aligned blocks of BLOCK leaves. A block keeps each of its levels
as one string of hex digests: fixed-width substrings of a level, two digests wide, hash to the next, and the digest
beside a node is the sibling in its proof. Roots of blocks are the leaves of the next round, until a group is one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import let
from .common import stored
from .decontam import bounded

HEX = 64
#: Levels within a block; a block has 1,024 leaves and a level of 64 KB at most.
LEVELS = 10
BLOCK = 1 << LEVELS
#: A field of a path: the side of the sibling and its digest. The last node of a level may have none.
LEFT, RIGHT, ALONE = "<", ">", "-"


def digest(*columns: Column) -> Column:
    """Hex SHA-256 of the columns' values: each is its UTF-8 byte count, a colon and the value as text; a null is a dash."""

    def field(c: Column) -> Column:
        return F.coalesce(let(c.cast("string"), lambda s: F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _at(raw: Column, k: Column, width: int) -> Column:
    """Field k (from 0) of fixed-width fields in bytes; cutting bytes does not walk through the string."""
    return F.substring(raw, (k * width + 1).cast("int"), F.lit(width))


def _count(raw: Column, width: int) -> Column:
    return F.floor((F.octet_length(raw) + (width - 1)) / width).cast("int")


def _upto(n: Column) -> Column:
    """0 to n - 1 as an array, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _parents(level: Column) -> Column:
    return let(level.cast("binary"), lambda raw: F.array_join(F.transform(_upto(_count(raw, 2 * HEX)), lambda k: F.sha2(_at(raw, k, 2 * HEX), 256)), ""))


def _levels(leaves: Column, rounds: Column) -> Column:
    """All levels of a block from its leaves up, one hex string each."""
    return F.aggregate(_upto(rounds), F.array(leaves), lambda ls, _: F.concat(ls, F.array(_parents(F.element_at(ls, -1)))))


def _segment(levels: Column, k: Column) -> Column:
    """Path of leaf k of a block up to the block's root. levels: the block's levels below its root, as bytes."""

    def step(raw: Column, height: Column) -> Column:
        def beside(here: Column) -> Column:
            other = here.bitwiseXOR(F.lit(1))
            side = F.when(other < here, LEFT).otherwise(RIGHT)
            return F.when(other * HEX < F.octet_length(raw), F.concat(side, _at(raw, other, HEX).cast("string"))).otherwise(F.lit(ALONE * (HEX + 1)))

        return let(F.floor(k / F.pow(F.lit(2.0), height)).cast("int"), beside)

    return F.array_join(F.transform(levels, step), "")


def ranked(leaves: DataFrame, group: str, order: list[str]) -> DataFrame:
    """leaves with i (rank within the group, from 0) and n (rows of the group).

    Range partitions are sorted and counted per group; the rank is the place in the partition plus the counts of the
    partitions before. Repeated rows are dealt by their place in the input, so that they need not share a task.
    """
    own = leaves.columns
    spread = leaves.withColumn("__tie", F.monotonically_increasing_id())
    keys = [group, *order, "__tie"]
    local = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    local = stored(local.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = local.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(
        F.col(group).alias("__g"), F.col("__part").alias("__p"), (F.sum("__rows").over(before) - F.col("__rows") - F.col("__first")).alias("__off"), F.sum("__rows").over(whole).alias("n")
    )
    at = local.join(bounded(offsets), (local[group] == F.col("__g")) & (F.col("__part") == F.col("__p")))
    return at.select(*own, (F.col("__at") + F.col("__off")).alias("i"), "n")


def _block_table(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(g, b, n, members, levels, root): aligned blocks of nodes (g, i, n, h and carried columns)."""
    place = F.floor(F.col("i") / BLOCK).cast("long")
    blocks = nodes.groupBy("g", place.alias("b")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "h", *carried))).alias("members"))
    rounds = F.when(F.col("n") > BLOCK, LEVELS).when(F.col("n") < 2, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    leaves = F.array_join(F.transform("members", lambda m: m["h"]), "")
    return blocks.withColumn("levels", _levels(leaves, rounds)).withColumn("root", F.element_at("levels", -1))


def _paths(level: DataFrame, above: DataFrame, on: list[str], carried: list[str]) -> DataFrame:
    """Each node of a level with its path to the root: g, i, h, carried columns, path, subroot, root."""
    joined = level.select("g", "b", "members", "levels").join(bounded(above), on)

    def members(levels: Column) -> Column:
        below = F.slice(levels, F.lit(1), F.size(levels) - 1)
        return F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in ("i", "h", *carried)], _segment(below, (m["i"] % BLOCK).cast("int")).alias("own")))

    each = let(F.transform("levels", lambda s: s.cast("binary")), members)
    rows = joined.select("g", "path", "subroot", "root", F.explode(each).alias("m"))
    return rows.select("g", *[f"m.{c}" for c in ("i", "h", *carried)], F.concat("m.own", "path").alias("path"), "subroot", "root")


def _trees(nodes: DataFrame, carried: list[str], outer: bool) -> DataFrame:
    """Paths of all nodes; outer: the roots of the groups, ordered by g, are the leaves of one more tree."""
    levels = [stored(_block_table(nodes, carried))]
    while (levels[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        nodes = levels[-1].select("g", F.col("b").alias("i"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("h"))
        levels.append(stored(_block_table(nodes, [])))
    above = levels[-1].select("g", F.lit("").alias("path"), F.col("root").alias("subroot"), "root")
    if outer:
        tops = ranked(levels[-1].select(F.lit(0).alias("g"), F.col("g").alias("name"), F.col("root").alias("h")), "g", ["name"])
        above = stored(_trees(tops, ["name"], False).select(F.col("name").alias("g"), "path", F.col("h").alias("subroot"), "root"))
    on = ["g"]
    for level in reversed(levels[1:]):
        above = stored(_paths(level, above, on, []).select("g", F.col("i").alias("b"), "path", "subroot", "root"))
        on = ["g", "b"]
    return _paths(levels[0], above, on, carried)


def manifest(rows: DataFrame, key: str = "doc_id", group: str = "lang", leaf: str = "leaf", carried: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of `rows`: key, leaf, the carried columns, path, subroot, root.

    `leaf` is the digest of a row. Within a group, leaves ascend by key (null first; rows that repeat a key by leaf); while
    there are several nodes, every two of them, and a last single one, become their digest. The roots of the groups,
    ordered bytewise, null first, make the root the same way. path lists the siblings from leaf to root (see fold).
    Keys, groups and leaves must not be named g, h, i, n. An empty table has no rows and no root.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    kept = [key, *carried]
    leaves = stored(rows.select(name.alias("g"), F.col(leaf).alias("h"), *kept))
    out = _trees(ranked(leaves, "g", [key, "h"]), kept, True)
    return out.select(key, F.col("h").alias(leaf), *carried, "path", "subroot", "root")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path lead to."""

    def up(node: Column, step: Column) -> Column:
        sibling = F.substring(step, 2, HEX)
        both = F.when(step.startswith(LEFT), F.concat(sibling, node)).when(step.startswith(RIGHT), F.concat(node, sibling)).otherwise(node)
        return F.sha2(both, 256)

    steps = let(path.cast("binary"), lambda raw: F.transform(_upto(_count(raw, HEX + 1)), lambda k: _at(raw, k, HEX + 1).cast("string")))
    return F.aggregate(steps, leaf, up)


def siblings(path: Column) -> Column:
    """The siblings of a path, concatenated in order."""
    return F.translate(path, LEFT + RIGHT + ALONE, "")
