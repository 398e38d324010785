"""Connected components of a link table, with the smallest node as the name of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship_by_value


#: A link table of at most so many rows, counted before, is finished by union-find in one task.
ONE_TASK = 200_000


def _forest(whole: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Union-find over the links of a task: links come back as links to roots, per batch or for the whole task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        def links() -> pd.DataFrame:
            pairs = [(x, find(x)) for x in list(parent)]
            return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["u", "v"], dtype="int64")

        for frame in frames:
            for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if not whole:
                yield links()
                parent.clear()
        if whole:
            yield links()

    return run


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node it reaches.

    Tasks first thin out their links by union-find. What is left is finished the same way in one task if it is
    counted to be small (one_task rows); the memory that takes is bounded by that number. Else large-star and small-star steps run until the links
    stop changing: each node of a task is tied to the smallest neighbour it knows. Every step is an aggregate of minima
    and an equi-join, so a hub with any number of links is neither collected nor expanded. Steps are
    cut by checkpoints. Null ends and loops are left out; an empty table has no components.
    """
    x, y = F.col(a), F.col(b)
    start = links.where(x != y).select(F.greatest(x, y).cast("long").alias("u"), F.least(x, y).cast("long").alias("v"))
    e = cut(start.mapInPandas(_forest(False), "u long, v long").distinct())
    seen = _state(e)
    if seen[0] <= one_task:
        e, seen = cut(e.coalesce(1).mapInPandas(_forest(True), "u long, v long")), (0,)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


ship_by_value(__name__)
