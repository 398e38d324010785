"""LM scoring: an interpolated modified Kneser-Ney bigram model.

Tasks count word pairs per batch, pairs are dealt over parts by a hash and merged there; each part is written
as sorted hash arrays to the shared folder, which workers map into memory to score texts. Words are known by 48 bits
of their hash, pairs by 64. Nothing but a dozen totals goes to the driver; the model grows with the corpus
and lies on disk.

The pair counts travel as packed columns, one row per part and batch, which takes a third of the room of
single rows. Model files stay in the shared folder until its owner clears it. The folder must be one that
workers can open as a path.
"""

from __future__ import annotations

import os
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import let
from .common import ascii_lower, cut, shared_folder, ship_by_value, words
from .minhash import mixed
from .samples import fold

HELD = 1
FOLDS = 5
BITS = 48
BEGIN = np.uint64(1)
END = np.uint64(2)
# Tokens handled at once; bounds the memory of a worker.
TOKENS = 3_000_000
#: Bytes of text whose pairs make a part of the model, and parts that a worker keeps mapped.
PART_BYTES = 16 << 20
OPEN_PARTS = 128


def token_hashes(text: Column) -> Column:
    """Hashes of the words of a text (A to Z lower-cased), without the end."""
    return F.transform(words(ascii_lower(F.coalesce(text, F.lit("")))), lambda w: F.xxhash64(w))


def pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mixed(mixed(u, 3) ^ v, 5)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts are equal ranges of the hash, so that the parts in order are one sorted array."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def pack(columns: list[np.ndarray]) -> bytes:
    """Unsigned columns of one length as planes of bytes, which compress well; each with its width in bytes."""
    out = [np.uint32(len(columns)).tobytes(), np.uint64(len(columns[0])).tobytes()]
    for c in columns:
        c = c.astype(np.uint64, copy=False)
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        planes = c.view(np.uint8).reshape(-1, 8)[:, :width].T
        out += [np.uint8(width).tobytes(), np.ascontiguousarray(planes).tobytes()]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    count, n = int(np.frombuffer(blob, np.uint32, 1)[0]), int(np.frombuffer(blob, np.uint64, 1, 4)[0])
    at, columns = 12, []
    for _ in range(count):
        width = blob[at]
        planes = np.frombuffer(blob, np.uint8, width * n, at + 1).reshape(width, n)
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = planes.T
        columns.append(full.view(np.uint64).ravel())
        at += 1 + width * n
    return columns


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in a sorted array."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts as (first, last, ends, previous tokens, tokens), each text with begin before and end behind."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOKENS, side="right")) - 1)
        to = min(n, to)
        starts = offsets[at : to + 1] - offsets[at] + np.arange(to - at + 1)
        tokens = np.full(int(starts[-1]), END, dtype=np.uint64)
        inner = np.ones(len(tokens), dtype=bool)
        inner[starts[1:] - 1] = False
        tokens[inner] = (values[offsets[at] : offsets[to]] >> np.uint64(64 - BITS)) | np.uint64(1 << 47)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[starts[:-1]] = BEGIN
        yield at, to, starts, before, tokens
        at = to


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _counter(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count the pairs of each batch: (part, blob of u, v, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, before, tokens in _texts(batch.column(0)):
                keys = pair_keys(before, tokens)
                order = np.argsort(keys)
                first = _runs(keys[order])
                picked = order[first]
                u, v, n = before[picked], tokens[picked], np.diff(np.append(first, len(keys)))
                ends = np.searchsorted(part_of(keys[picked], parts), np.arange(parts + 1))
                full = np.flatnonzero(np.diff(ends))
                blobs = []
                for p in full:
                    s = np.argsort(u[ends[p] : ends[p + 1]]) + ends[p]
                    blobs.append(pack([u[s], v[s], n[s]]))
                yield _batch(part=pa.array(full, pa.int32()), blob=pa.array(blobs, pa.binary()))

    return run


def _write(folder: str, name: str, columns: dict[str, np.ndarray]) -> None:
    """Write arrays under their final names in one step each, so that a repeated task does no harm."""
    for kind, values in columns.items():
        path = os.path.join(folder, f"{name}.{kind}.npy")
        temporary = f"{path}.{uuid.uuid4().hex}"
        with open(temporary, "wb") as f:
            np.save(f, values)
        os.replace(temporary, path)


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in 4 bytes each where all of them fit, else in 8."""
    return n.astype(np.uint32 if not n.size or n.max() < 1 << 32 else np.uint64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[bytes]]:
    blobs: dict[int, list[bytes]] = defaultdict(list)
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            blobs[part].append(blob)
    return blobs


def _counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _pair_merger(folder: str, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge the pairs of a part, write it, and pass on what its words need: (part, blob, n1..n4).

    Per word: count and predecessors of v; total and successors seen once, twice, more often of u.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _gathered(batches).items():
            u, v, n = (np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True))
            keys = pair_keys(u, v)
            order = np.argsort(keys)
            first = _runs(keys[order])
            n = np.add.reduceat(n[order], first)
            u, v, keys = u[order][first], v[order][first], keys[order][first]
            _write(folder, f"pairs-{part:07d}", {"key": keys, "n": _narrow(n)})
            names = np.concatenate([v, u])
            none = np.zeros(len(n), np.uint64)
            facts = [
                np.concatenate([n, none]), np.concatenate([none + np.uint64(1), none]), np.concatenate([none, n]),
                *(np.concatenate([none, hit.astype(np.uint64)]) for hit in (n == 1, n == 2, n >= 3)),
            ]
            at = np.argsort(names)
            starts = _runs(names[at])
            words_here, sums = names[at][starts], [np.add.reduceat(f[at], starts) for f in facts]
            ends = np.searchsorted(part_of(mixed(words_here, 9), parts)[(o := np.argsort(mixed(words_here, 9)))], np.arange(parts + 1))
            full = np.flatnonzero(np.diff(ends))
            packed = [pack([c[s] for c in (words_here, *sums)]) for p in full for s in [np.sort(o[ends[p] : ends[p + 1]])]]
            totals = [[c if i == 0 else 0 for i in range(len(full))] for c in _counts_of_counts(n)]
            yield _batch(part=pa.array(full, pa.int32()), blob=pa.array(packed, pa.binary()), **{f"n{k + 1}": pa.array(t, pa.int64()) for k, t in enumerate(totals)})

    return run


def _word_merger(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Merge what is known of the words of a part, write it, and return totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in _gathered(batches).items():
            names, *facts = (np.concatenate(c) for c in zip(*map(unpack, blobs), strict=True))
            keys = mixed(names, 9)
            order = np.argsort(keys)
            first = _runs(keys[order])
            count, before, total, one, two, more = (np.add.reduceat(f[order], first) for f in facts)
            after = _narrow(np.stack([one, two, more], axis=1))
            _write(folder, f"words-{part:07d}", {"key": keys[order][first], "count": count, "before": _narrow(before), "total": total, "after": after})
            sums = [int((count > 0).sum()), int(count.sum()), int(before.sum()), *_counts_of_counts(before), int((before > 2).sum())]
            yield _batch(**{k: pa.array([s], pa.int64()) for k, s in zip(("v", "n", "pairs", "m1", "m2", "m3", "m4", "many"), sums, strict=True)})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken from counts 0, 1, 2 and 3 or more; fixed shares where a count of counts is missing."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))])


@dataclass
class Model:
    """Where the arrays lie, and the totals: tokens and distinct tokens, pairs, discounts, weight left to the uniform part."""

    folder: str
    parts: int
    tokens: int
    vocabulary: int
    pairs: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    rest: float


def fit(docs: DataFrame, folder: str | None = None, folds: int = FOLDS, held: int = HELD) -> Model:
    """Learn from the texts outside fold `held`; null texts are empty, null ids are learned from."""
    spark = docs.sparkSession
    place = os.path.join(folder or _path(spark), f"lm-{uuid.uuid4().hex}")
    os.makedirs(place, exist_ok=True)
    given = docs.where(F.coalesce(fold(F.col("doc_id"), folds) != held, F.lit(True))).select("text")
    # The model has so many parts that a task merges what PART_BYTES of text hold, whatever the size of the corpus.
    parts = 1 + (given.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES
    learned = given.select(token_hashes(F.col("text")).alias("tokens"))
    counted = learned.mapInArrow(_counter(parts), "part int, blob binary").repartition(parts, "part")
    merged = cut(counted.mapInArrow(_pair_merger(place, parts), "part int, blob binary, n1 long, n2 long, n3 long, n4 long"))
    pair_counts = merged.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in (1, 2, 3, 4)]).first()
    names = ("v", "n", "pairs", "m1", "m2", "m3", "m4", "many")
    totals = merged.select("part", "blob").repartition(parts, "part").mapInArrow(_word_merger(place), ", ".join(f"{k} long" for k in names))
    v, n, pairs, m1, m2, m3, m4, many = totals.agg(*[F.coalesce(F.sum(k), F.lit(0)) for k in names]).first()
    less = discounts(m1, m2, m3, m4)
    rest = float(less[1] * m1 + less[2] * m2 + less[3] * many) / pairs if pairs else 1.0
    return Model(place, parts, n, v, pairs, discounts(*pair_counts), less, rest)


def _path(spark: SparkSession) -> str:
    url = urlparse(shared_folder(spark))
    if url.scheme not in ("", "file"):
        raise ValueError("workers map the model from a path: pass a folder on a mounted shared file system")
    return url.path


class Arrays:
    """The mapped arrays of a model in one worker."""

    def __init__(self, model: Model):
        self.model, self.files = model, {}

    def find(self, name: str, kinds: tuple[str, ...], keys: np.ndarray) -> list[np.ndarray]:
        """Values of sorted keys; 0 for those that are not there."""
        ends = np.searchsorted(part_of(keys, self.model.parts), np.arange(self.model.parts + 1))
        out: list[np.ndarray] = []
        for p in np.flatnonzero(np.diff(ends)):
            held, *values = self._open(f"{name}-{p:07d}", ("key", *kinds))
            if not out:
                out = [np.zeros((len(keys), *v.shape[1:]), np.uint64) for v in values]
            if not len(held):
                continue
            asked = keys[ends[p] : ends[p + 1]]
            at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
            hit = np.asarray(held[at]) == asked
            for o, v in zip(out, values, strict=True):
                o[ends[p] : ends[p + 1]][hit] = v[at[hit]]
        return out

    def _open(self, name: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
        if name not in self.files:
            if len(self.files) >= OPEN_PARTS:  # a mapped file takes a descriptor; the first that was mapped goes
                self.files.pop(next(iter(self.files)))
            paths = [os.path.join(self.model.folder, f"{name}.{k}.npy") for k in kinds]
            empty = {"after": np.zeros((0, 3), np.uint32)}
            self.files[name] = [np.load(p, mmap_mode="r") if os.path.exists(p) else empty.get(k, np.zeros(0, np.uint64)) for k, p in zip(kinds, paths, strict=True)]
        return self.files[name]

    def scores(self, starts: np.ndarray, before: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
        """Per text: tokens, known tokens, base score and model score (log10)."""
        m = self.model
        names, at = np.unique(np.concatenate([tokens, before[starts[:-1]]]), return_inverse=True)
        keys = mixed(names, 9)
        order = np.argsort(keys)
        found = self.find("words", ("count", "before", "total", "after"), keys[order])
        facts = [np.zeros((len(names), *f.shape[1:])) for f in found]
        for f, g in zip(facts, found, strict=True):
            f[order] = g
        count, preceding, total, after = facts
        base = np.log10((count + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1)))
        level = np.minimum(preceding, 3).astype(int)
        lower = np.maximum(preceding - m.word_discounts[level], 0) / max(m.pairs, 1) + m.rest / (m.vocabulary + 1)
        left = np.where(total > 0, (after @ m.pair_discounts[1:]) / np.maximum(total, 1), 1.0)
        w = at[: len(tokens)]
        c = np.empty_like(w)
        c[1:] = w[:-1]
        c[starts[:-1]] = at[len(tokens) :]
        pair = pair_keys(before, tokens)
        asked = np.argsort(pair)
        n = np.zeros(len(pair))
        n[asked] = self.find("pairs", ("n",), pair[asked])[0]
        direct = np.maximum(n - m.pair_discounts[np.minimum(n, 3).astype(int)], 0) / np.maximum(total[c], 1)
        logs = np.log10(direct + left[c] * lower[w])
        begin = starts[:-1]
        return [np.diff(starts), np.add.reduceat((count[w] > 0).astype(np.int64), begin), np.add.reduceat(base[w], begin), np.add.reduceat(logs, begin)]


def _scorer(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        for batch in batches:
            for a, b, starts, before, tokens in _texts(batch.column(1)):
                n, known, base, score = arrays.scores(starts, before, tokens)
                yield _batch(doc_id=batch.column(0).slice(a, b - a), n_tokens=pa.array(n), n_known=pa.array(known), base_score=pa.array(base), score=pa.array(score))

    return run


def lm_scores(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    score is the log10 probability of the words and the end; perplexity is per token. Null texts are
    empty texts, which have the end alone. A null doc_id is not held out.
    """
    model = model or fit(docs)
    given = docs.select("doc_id", token_hashes(F.col("text")).alias("tokens"))
    scored = given.mapInArrow(_scorer(model), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == HELD, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        let(F.col("score") / F.col("n_tokens"), lambda s: F.pow(F.lit(10.0), -s)).alias("perplexity"),
    )


ship_by_value(__name__)
