"""Folds by crc32 and bounded training samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, folds: int = 5) -> Column:
    """crc32 of the key as text modulo folds; null for null."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def per_label(labelled: DataFrame, label: str, rows: int) -> DataFrame:
    """(d, label) of at most `rows` rows per label, the first by hash of the key d; the same on every run.

    Each label takes its own ordered limit, so tasks pass on no more than `rows` rows.
    """
    labels = [r[0] for r in labelled.select(label).distinct().orderBy(label).collect()]
    parts = [labelled.where(F.col(label) == v).orderBy(F.xxhash64("d"), "d").limit(rows) for v in labels]
    out = labelled.limit(0)
    for part in parts:
        out = out.unionByName(part)
    return out
