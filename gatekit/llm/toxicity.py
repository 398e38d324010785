"""Toxicity: a factorization machine over hashed terms.

Terms are words (letters and digits, lower-cased) and their first four characters, hashed; a text is its set of terms.
The score is a logistic over single weights and products of factor vectors, so that a pair of terms can
weigh more than its parts. The machine is trained with numpy on a bounded sample of labelled texts and scores
every text in tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.numeric import let
from .common import cut, ship_by_value
from .samples import fold, per_label

PREFIX = 4
#: At most this many labelled texts of each class are learned from.
SAMPLE = 4000
#: Terms in fewer of these texts, or whose presence depends less on the label (0.001 level), are not learned.
MIN_TEXTS = 3
LEAST_CHI2 = 10.83
FACTORS = 4
EPOCHS = 15
RATE = 0.1
L1 = 2e-4
L2 = 1e-4
SEED = 11


def term_hashes(text: Column) -> Column:
    """The set of hashed terms of a text; empty for null."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")

    def terms(w: Column) -> Column:
        starts = F.transform(w, lambda x: F.hash(F.lit("start"), F.substring(x, 1, PREFIX)))
        return F.concat(F.transform(w, lambda x: F.hash(x)), starts)

    return F.array_distinct(let(F.array_remove(F.split(cleaned, " "), ""), terms))


@dataclass
class Machine:
    """terms: known hashes, sorted; weights and factors per term; bias."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def score(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities for sets of term hashes laid end to end. Unknown terms count nothing."""
        if not len(self.terms):
            return np.full(len(offsets) - 1, 1 / (1 + np.exp(-self.bias)))
        at = np.minimum(np.searchsorted(self.terms, values), len(self.terms) - 1)
        known = self.terms[at] == values
        rows = at[known]
        ends = np.concatenate([[0], np.cumsum(known)])[offsets]
        return 1 / (1 + np.exp(-_raw(self, rows, ends)[0]))


def _sums(x: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of x between ends; 0 for empty runs."""
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0, dtype=np.float64)])
    return total[ends[1:]] - total[ends[:-1]]


def _raw(machine: Machine, rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = machine.factors[rows]
    joint = _sums(v, ends)
    pairs = 0.5 * (joint**2 - _sums(v**2, ends)).sum(axis=1)
    return np.clip(machine.bias + _sums(machine.weights[rows], ends) + pairs, -30, 30), joint


def dependence(row: np.ndarray, label: np.ndarray, texts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Chi-square of each term's presence against the label, with Yates' correction."""
    n, ones = len(labels), labels.sum()
    with_one = np.bincount(row, label, len(texts))
    gap = np.maximum(np.abs(with_one * n - texts * ones) - n / 2, 0)
    return n * gap**2 / np.maximum(1.0, texts * (n - texts) * ones * (n - ones))


def train(values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, odds: float, seed: int = SEED) -> Machine:
    """Adagrad over small batches; weights shrink to zero under L1. odds: odds of label 1 among all labelled texts.

    The sample holds classes in other shares than the corpus; the bias is moved by the difference at the end.
    """
    names, row, texts = np.unique(values, return_inverse=True, return_counts=True)
    keep = (texts >= MIN_TEXTS) & (dependence(row, np.repeat(labels, np.diff(offsets)), texts, labels) >= LEAST_CHI2)
    place = np.cumsum(keep) - 1
    known = keep[row]
    rows, ends = place[row[known]], np.concatenate([[0], np.cumsum(known)])[offsets]
    rng = np.random.default_rng(seed)
    n = int(keep.sum())
    machine = Machine(names[keep], np.zeros(n), rng.normal(0, 0.01, (n, FACTORS)), 0.0)
    gw, gv, gb = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS if n else 0):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), 64):
            batch = order[start : start + 64]
            spans = [np.arange(ends[b], ends[b + 1]) for b in batch]
            own = np.concatenate([[0], np.cumsum([len(s) for s in spans])])
            r = rows[np.concatenate(spans)]
            raw, joint = _raw(machine, r, own)
            error = (1 / (1 + np.exp(-raw)) - labels[batch]) / len(batch)
            each = np.repeat(error, np.diff(own))
            used, back = np.unique(r, return_inverse=True)
            dw = np.bincount(back, each, len(used)) + L2 * machine.weights[used]
            slope = each[:, None] * (np.repeat(joint, np.diff(own), axis=0) - machine.factors[r])
            dv = np.stack([np.bincount(back, slope[:, f], len(used)) for f in range(FACTORS)], axis=1) + L2 * machine.factors[used]
            gw[used] += dw**2
            gv[used] += dv**2
            step = RATE / np.sqrt(gw[used])
            moved = machine.weights[used] - step * dw
            machine.weights[used] = np.sign(moved) * np.maximum(np.abs(moved) - step * L1, 0)
            machine.factors[used] -= RATE / np.sqrt(gv[used]) * dv * 0.2
            gb += error.sum() ** 2
            machine.bias -= RATE / np.sqrt(gb) * error.sum()
    positive = labels.mean() if len(labels) else 0.0
    if 0 < positive < 1 and odds > 0:
        machine.bias += float(np.log(odds) - np.log(positive / (1 - positive)))
    return machine


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, folds: int = 5, held: int = 0) -> Machine:
    """Learn from labelled texts outside fold `held`. Null labels and ids are skipped, of repeated ids the larger label counts.

    Without both classes there is nothing to learn; the machine then gives every text the same low score.
    """
    known = labels.select(F.col("doc_id").alias("d"), F.col(label).alias("y")).where("d IS NOT NULL AND y IS NOT NULL")
    usable = known.where(fold(F.col("d"), folds) != held).groupBy("d").agg(F.max("y").cast("int").alias("y"))
    chosen = cut(per_label(usable, "y", sample))
    counts = {r.y: r.n for r in usable.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = docs.select(F.col("doc_id").alias("d"), "text").join(F.broadcast(chosen), "d").select("y", term_hashes(F.col("text")).alias("terms"), "d")
    table = texts.orderBy(F.xxhash64("d"), "d", F.size("terms")).toArrow()
    column = table.column("terms").combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False) if len(table) else np.zeros(0, np.int32)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False) if len(table) else np.zeros(0, np.int32)
    y = table.column("y").to_numpy().astype(float) if len(table) else np.zeros(0)
    if len(set(y)) < 2:
        return Machine(np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)), -5.0)
    return train(values, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), y, counts.get(1, 0) / max(1, counts.get(0, 0)))


def _scorer(machine: Machine, keep: int, name: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(keep)
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
            scores = machine.score(values, offsets - offsets[0])
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(scores)], names=[*batch.schema.names[:keep], name])

    return run


def score(docs: DataFrame, machine: Machine, columns: list[str], name: str = "score") -> DataFrame:
    """The columns of docs and a column `name` with the score, one row per row. Null and empty texts have no terms and get the score of the bias."""
    given = docs.select(*[F.col(f"`{c}`") for c in columns], term_hashes(F.col("text")).alias("__terms"))
    schema = StructType([*given.drop("__terms").schema.fields, StructField(name, DoubleType())])
    return given.mapInArrow(_scorer(machine, len(columns), name), schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted. A null doc_id is not held out."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, sample=sample), ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


ship_by_value(__name__)
