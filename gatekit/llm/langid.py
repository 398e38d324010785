"""Language ID: averaged embeddings of hashed subwords with a linear softmax.

Subwords are the byte n-grams of the lower-cased text, white space runs cut to one blank. A text is the mean of its
subword embeddings; the softmax is linear in that mean, so after training each subword holds one row of
language scores and a text is scored by averaging rows. Trained by stochastic gradient descent in numpy on a bounded
sample; a temperature and a rejection threshold are calibrated on a part of the sample kept aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, ship_by_value
from .samples import fold, per_label

SIZES = (2, 3, 4)
BITS = 16
DIM = 16
#: At most this many texts of each language are learned from, a fifth of them for calibration.
SAMPLE = 300
EPOCHS = 8
RATE = 0.5
#: Share of accepted texts that calibration wants right.
PRECISION = 0.99
SMOOTH = 0.01
SEED = 5
# Bytes handled at once; bounds the memory of a worker.
BYTES = 2_000_000
UNKNOWN = "und"


def subwords(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per n-gram size the hashed n-grams of texts laid end to end in data (uint8), and where those of each text start.

    starts has one more entry than texts. N-grams do not cross texts; a text shorter than n has none.
    """
    x = data.astype(np.uint32)
    for n in SIZES:
        if len(x) < n:
            yield np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
            continue
        code = x[: len(x) - n + 1].copy()
        for k in range(1, n):
            code |= x[k : len(x) - n + 1 + k] << np.uint32(8 * k)
        code = (code * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS)
        lengths = np.diff(starts)
        own = np.maximum(lengths - n + 1, 0)
        keep = np.ones(len(code), dtype=bool)
        for k in range(1, n):
            last = starts[1:] - k
            last = last[(last >= starts[:-1]) & (last < len(code))]
            keep[last] = False
        yield code[keep].astype(np.int64), np.concatenate([[0], np.cumsum(own)])


@dataclass
class Classifier:
    """scores: one row of language scores per subword bucket; bias; temperature; threshold of rejection."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        texts = len(starts) - 1
        total, count = np.zeros((texts, len(self.languages))), np.zeros(texts)
        for codes, ends in subwords(data, starts):
            count += np.diff(ends)
            full = np.flatnonzero(np.diff(ends) > 0)
            if len(full):
                for c in range(len(self.languages)):
                    total[full, c] += np.add.reduceat(self.scores[codes, c], ends[full], dtype=np.float64)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(data, starts) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(data: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their shares."""
    parts = list(subwords(data, starts))
    bags = []
    for i in range(len(starts) - 1):
        ids, n = np.unique(np.concatenate([codes[ends[i] : ends[i + 1]] for codes, ends in parts]), return_counts=True)
        bags.append((ids, n / max(1, n.sum())))
    return bags


def train(data: np.ndarray, starts: np.ndarray, labels: list[str], seed: int = SEED) -> Classifier:
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    bags = _bags(data, starts)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~aside)
    table = rng.normal(0, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    head, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    # Texts are short on evidence per bucket: steps on the table are scaled up to undo the averaging.
    steps = EPOCHS * len(learn)
    done = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            ids, share = bags[i]
            rate = RATE * (1 - done / steps)
            mean = share @ table[ids]
            p = _softmax((mean @ head + bias)[None])[0]
            p[y[i]] -= 1
            back = head @ p
            head -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            table[ids] -= (rate * 20 * share[:, None] * back).astype(np.float32)
            done += 1
    made = Classifier(languages, (table @ head).astype(np.float32), bias)
    return calibrate(made, data, starts, y, aside)


def calibrate(made: Classifier, data: np.ndarray, starts: np.ndarray, y: np.ndarray, aside: np.ndarray) -> Classifier:
    """Pick the temperature of least log loss and the lowest threshold that keeps PRECISION, on the texts set aside."""
    if not aside.any():
        return made
    z = made.logits(data, starts)[aside]
    want = y[aside]
    # Smoothed labels keep scores short of certainty where every text set aside is right.
    goal = np.full(z.shape, SMOOTH / z.shape[1])
    goal[np.arange(len(want)), want] += 1 - SMOOTH
    loss = {t: -(goal * np.log(_softmax(z / t) + 1e-12)).sum(axis=1).mean() for t in np.geomspace(0.1, 10, 40)}
    made.temperature = float(min(loss, key=loss.get))
    p = _softmax(z / made.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == want
    order = np.argsort(-top)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    made.threshold = float(top[order][good[-1]]) if len(good) else 1.0
    return made


def _normal(text):
    """The text that is scored: lower case, white space runs as one blank, a blank at both ends."""
    inner = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " ")
    return F.concat(F.lit(" "), inner, F.lit(" "))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), ends


def fit(docs: DataFrame, sample: int = SAMPLE, folds: int = 5, held: int = 0) -> Classifier:
    """Learn from texts with a lang outside fold `held`; null ids, langs and texts without letters are skipped."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = usable.select(F.col("doc_id").alias("d"), "lang").where(fold(F.col("d"), folds) != held).groupBy("d").agg(F.min("lang").alias("lang"))
    chosen = cut(per_label(known, "lang", sample))
    texts = usable.select(F.col("doc_id").alias("d"), _normal(F.col("text")).alias("body")).join(F.broadcast(chosen), "d")
    table = texts.orderBy(F.xxhash64("d"), "d", F.xxhash64("body")).select("lang", "body").toArrow()
    if not len(table):
        return Classifier([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    data, ends = _buffers(table.column("body").combine_chunks())
    return train(data[ends[0] : ends[-1]], ends - ends[0], table.column("lang").to_pylist())


def _predictor(made: Classifier, keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*made.languages, UNKNOWN], dtype=object)
        for batch in batches:
            lettered = batch.column(keep).to_numpy(zero_copy_only=False).astype(bool)
            data, ends = _buffers(batch.column(keep + 1))
            best, score = np.full(len(batch), len(names) - 1), np.zeros(len(batch))
            at = 0
            while made.languages and at < len(batch):
                to = max(at + 1, min(len(batch), int(np.searchsorted(ends, ends[at] + BYTES, side="right")) - 1))
                p = made.probabilities(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
                best[at:to], score[at:to] = p.argmax(axis=1), p.max(axis=1)
                at = to
            best, score = np.where(lettered, best, len(names) - 1), np.where(lettered, score, 0.0)
            out = [*batch.columns[:keep], pa.array(names[best], pa.string()), pa.array(score), pa.array(score < made.threshold)]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:keep], "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, made: Classifier) -> DataFrame:
    """doc_id, lang_pred, score, rejected per row. Null texts and those without a letter are `und` with score 0 and rejected."""
    given = docs.select("doc_id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), _normal(F.col("text")).alias("body"))
    return given.mapInArrow(_predictor(made, 1), "doc_id long, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, rejected.

    rejected marks scores below the calibrated threshold; lang_pred names the best language all the same.
    Where no row can be learned from, every text is `und`. A null doc_id is not held out.
    """
    predicted = predict(docs, fit(docs, sample))
    return predicted.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


ship_by_value(__name__)
