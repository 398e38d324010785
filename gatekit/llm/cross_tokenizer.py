"""Cross-tokenizer alignment: the tokens of two tokenizers on the same bytes, and how often their ids meet.

Texts are encoded once by both tokenizers into a table of packed ids. Bytes where tokens of both end cut a text into
groups; between two ends of either kind lies exactly one pair of overlapping tokens, a link. An id of A whose bytes are
an id of B has an identity link: those are counted per document in vectors as long as the vocabulary. Only other pairs,
from groups that are not one to one, are counted by a shuffle, pre-aggregated in the tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, stored

VOCABULARIES = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = f"{VOCABULARIES}/byte_bpe_50k.json", f"{VOCABULARIES}/piece_bpe_32k.model"
# Fixed value: the pattern by which byte-level BPE splits texts before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Counts of so many pairs, the most frequent, are sent to the tasks (16 bytes each); links of rarer pairs are joined.
KNOWN_PAIRS = 1_000_000
#: A task hands on its pair counts when it holds so many.
HELD_PAIRS = 2_000_000
#: Texts are worked on in runs of about so many bytes of packed ids.
RUN_BYTES = 2_000_000


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as themselves, the others as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabularies:
    """Both tokenizers as files' contents, small enough to travel with a task; encoders are built where they are used."""

    byte_bpe: str
    piece_bpe: bytes
    bytes_a: list[bytes] = field(init=False)
    bytes_b: list[bytes] = field(init=False)

    def __post_init__(self) -> None:
        model = json.loads(self.byte_bpe)
        back, vocab = _byte_of(), model["model"]["vocab"]
        special = {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        size = max(*vocab.values(), *special) + 1
        self.bytes_a = [b""] * size
        for token, k in vocab.items():
            self.bytes_a[k] = special.get(k) or bytes(back[c] for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        if any(vocab["".join(m)] != 256 + k for k, m in enumerate(merges)):
            raise ValueError("the ids of the byte-level vocabulary must follow its merges")
        self.special = special
        pieces = self.pieces()
        self.bytes_b = [b""] * pieces.get_piece_size()
        for k in range(len(self.bytes_b)):
            piece = pieces.id_to_piece(k)
            self.bytes_b[k] = bytes([int(piece[3:5], 16)]) if pieces.is_byte(k) else piece.replace("▁", " ").encode()
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in v], dtype=np.int64) for v in (self.bytes_a, self.bytes_b))
        first = {}
        for k, x in enumerate(self.bytes_b):
            if not (pieces.is_control(k) or pieces.is_unknown(k)):
                first.setdefault(x, k) if pieces.is_byte(k) else first.update({x: k})
        self.same = np.array([first.get(x, -1) for x in self.bytes_a], dtype=np.int64)

    @classmethod
    def load(cls, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> Vocabularies:
        return cls(Path(byte_bpe).read_text(encoding="utf-8"), Path(piece_bpe).read_bytes())

    def pieces(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=self.piece_bpe)

    def encoders(self) -> tuple[Callable[[str], list[int]], Callable[[str], list[int]]]:
        """Text to ids of A (of a space and the text) and of B (which adds the space itself), without special tokens."""
        import tiktoken

        ranks = {x: k for k, x in enumerate(self.bytes_a) if k not in self.special}
        merged = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        pieces = self.pieces()
        return (lambda text: merged.encode_ordinary(" " + text)), (lambda text: pieces.encode(text, num_threads=1))


def _encode(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, doc_id, text as bytes) to (row, doc_id, a, b): ids as packed 16-bit numbers, empty where the text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        to_a, to_b = v.encoders()
        bytes_a, bytes_b = v.bytes_a, v.bytes_b

        def packed(raw: bytes | None) -> tuple[bytes, bytes]:
            if not raw:
                return b"", b""
            want, text = b" " + raw, raw.decode("utf-8", "replace")
            a, b = to_a(text), to_b(text)
            if b"".join([bytes_a[k] for k in a]) != want or b"".join([bytes_b[k] for k in b]) != want:
                return b"", b""
            return np.array(a, dtype="<u2").tobytes(), np.array(b, dtype="<u2").tobytes()

        for batch in batches:
            both = [packed(x.as_py()) for x in batch.column("text")]
            columns = [batch.column("row"), batch.column("doc_id"), *(pa.array([x[k] for x in both], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "a", "b"])

    return run


def tokens(docs: DataFrame, shared) -> DataFrame:
    """(row, doc_id, a, b): the packed ids of every document's text, as a stored table; row tells apart repeated doc_ids."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(rows.mapInArrow(_encode(shared), f"row long, doc_id {kind}, a binary, b binary"), "zstd")


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a packed column and the number of ids of each row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    ids = np.frombuffer(data, dtype="<u2", count=(at[-1] - at[0]) // 2, offset=int(at[0])) if data is not None and at[-1] > at[0] else np.zeros(0, "<u2")
    return ids.astype(np.int64), np.diff(at) // 2


@dataclass
class Links:
    """The links of a run of documents, in byte order. Texts of both sides have equal bytes, so offsets run on over texts."""

    a: np.ndarray
    b: np.ndarray
    doc: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray

    @classmethod
    def of(cls, v: Vocabularies, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray) -> Links:
        end_a, end_b = np.cumsum(v.lengths_a[ids_a]), np.cumsum(v.lengths_b[ids_b])
        at = np.zeros((2, int(end_a[-1]) + 1 if len(end_a) else 1), dtype=bool)
        at[0, end_a] = at[1, end_b] = True
        ends = np.flatnonzero(at[0] | at[1])
        a_ends, b_ends = at[0, ends], at[1, ends]
        nth_a, nth_b = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
        return cls(ids_a[nth_a], ids_b[nth_b], np.repeat(np.arange(len(n_a)), n_a)[nth_a], a_ends, b_ends)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about RUN_BYTES; a longer text is a slice of its own."""
    sizes = np.cumsum([len(x.as_buffer() or b"") for x in batch.column("a")]) if batch.num_rows else np.zeros(0)
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + RUN_BYTES)))
        yield batch.slice(start, stop - start)
        start = stop


def _count(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b) to (pair, same, n): in how many documents of the task each pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        size_a, size_b = len(v.bytes_a), len(v.bytes_b)
        square = size_a * size_b
        vector = np.zeros(size_a, dtype=np.int64)
        keys, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def merge() -> None:
            every, n = np.concatenate(keys), np.concatenate(numbers)
            order = np.argsort(every, kind="stable")
            every, n = every[order], n[order]
            first = np.flatnonzero(np.diff(every, prepend=-1))
            keys[:], numbers[:] = [every[first]], [np.add.reduceat(n, first) if len(first) else n]

        def out(pairs: np.ndarray, n: np.ndarray, same: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.full(len(pairs), same)), pa.array(n)], ["pair", "same", "n"])

        for batch in batches:
            for part in _runs(batch):
                ids_a, n_a = _ids(part.column("a"))
                ids_b, _ = _ids(part.column("b"))
                x = Links.of(v, ids_a, n_a, ids_b)
                same = v.same[x.a] == x.b
                vector += np.bincount(np.unique(x.doc[same] * size_a + x.a[same]) % size_a, minlength=size_a)
                odd = np.unique(x.doc[~same] * square + x.a[~same] * size_b + x.b[~same]) % square
                pairs, n = np.unique(odd, return_counts=True)
                keys.append(pairs)
                numbers.append(n.astype(np.int64))
                if sum(map(len, keys)) > HELD_PAIRS:
                    merge()
                    if len(keys[0]) > HELD_PAIRS // 2:
                        yield out(keys[0], numbers[0], False)
                        keys[:], numbers[:] = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        merge()
        yield out(keys[0], numbers[0], False)
        met = np.flatnonzero(vector)
        yield out(met * size_b + v.same[met], vector[met], True)

    return run


def pair_counts(packed: DataFrame, shared) -> DataFrame:
    """(pair, same, n): pair is a * size of B + b, n in how many documents of the corpus the two are linked."""
    each = packed.select("a", "b").mapInArrow(_count(shared), "pair long, same boolean, n long")
    return stored(each.groupBy("pair", "same").agg(F.sum("n").alias("n")))


@dataclass
class Known:
    """What the tasks know of the counts: best count per id of A, counts of identity links, counts of the frequent pairs."""

    best: np.ndarray
    same: np.ndarray
    pairs: np.ndarray
    numbers: np.ndarray

    def counts(self, v: Vocabularies, x: Links) -> tuple[np.ndarray, np.ndarray]:
        """The count of every link, 0 where it is not known here, and its pair."""
        pair = x.a * len(v.bytes_b) + x.b
        n = np.where(v.same[x.a] == x.b, self.same[x.a], 0)
        odd = np.flatnonzero(n == 0)
        if len(odd) and len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair[odd]), len(self.pairs) - 1)
            n[odd] = np.where(self.pairs[at] == pair[odd], self.numbers[at], 0)
        return n, pair


def _known(counts: DataFrame, v: Vocabularies, known_pairs: int) -> tuple[Known, DataFrame]:
    """The bounded part of the counts for the tasks, and the table of the pairs that are left."""
    size_a, size_b = len(v.bytes_a), len(v.bytes_b)
    a = F.floor(F.col("pair") / size_b).cast("int")
    best, same = np.zeros(size_a, np.int64), np.zeros(size_a, np.int64)
    tops = counts.groupBy(a.alias("a")).agg(F.max("n").alias("n"), F.max(F.when(F.col("same"), F.col("n"))).alias("same")).toArrow()
    at = tops.column("a").to_numpy()
    best[at], same[at] = tops.column("n").to_numpy(), tops.column("same").fill_null(0).to_numpy()
    odd = counts.where(~F.col("same"))
    scale = {r.scale: r.pairs for r in odd.groupBy(F.length(F.bin("n")).alias("scale")).agg(F.count(F.lit(1)).alias("pairs")).collect()}
    least, room = 64, known_pairs
    while least > 0 and room >= scale.get(least, 0):
        room -= scale.get(least, 0)
        least -= 1
    frequent = odd.where(F.length(F.bin("n")) > least).select("pair", "n").toArrow()
    pairs, n = frequent.column("pair").to_numpy(), frequent.column("n").to_numpy()
    order = np.argsort(pairs)
    rare = odd.where(F.length(F.bin("n")) <= least)
    return Known(best, same, pairs[order], n[order]), rare if any(k <= least for k in scale) else rare.limit(0)


def _rare_links(shared, known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, a, b) to (row, pair, links): links whose counts the task does not know."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, k = shared.value, known.value
        square = len(v.bytes_a) * len(v.bytes_b)
        for batch in batches:
            for part in _runs(batch):
                ids_a, n_a = _ids(part.column("a"))
                x = Links.of(v, ids_a, n_a, _ids(part.column("b"))[0])
                n, pair = k.counts(v, x)
                keys, links = np.unique((x.doc * square + pair)[n == 0], return_counts=True)
                rows = part.column("row").to_numpy()[keys // square]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(keys % square), pa.array(links.astype(np.int64))], ["row", "pair", "links"])

    return run


def _report(shared, known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, doc_id, a, b) to one row per document with sums over its links and its groups as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, k = shared.value, known.value
        size_a = len(v.bytes_a)
        # An id, and what follows it within its group or at the end of its side.
        shown = [f"{i}{end}" for size, ends in ((size_a, ",|"), (len(v.bytes_b), ",;")) for end in ends for i in range(size)]

        def rendered(x: Links, ids_a: np.ndarray, ids_b: np.ndarray, sizes: np.ndarray) -> list[str]:
            common = x.a_ends & x.b_ends
            group = np.cumsum(common) - common
            of_a, of_b = group[x.a_ends], group[x.b_ends]
            last_a, last_b = (np.diff(g, append=-1) != 0 for g in (of_a, of_b))
            codes = np.concatenate([ids_a + size_a * last_a, 2 * size_a + ids_b + len(v.bytes_b) * last_b])
            order = np.argsort(np.concatenate([2 * of_a, 2 * of_b + 1]), kind="stable")
            words, out, start = [shown[c] for c in codes[order].tolist()], [], 0
            for size in sizes.tolist():
                out.append("".join(words[start : start + size])[:-1])
                start += size
            return out

        for batch in batches:
            for part in _runs(batch):
                (ids_a, n_a), (ids_b, n_b) = _ids(part.column("a")), _ids(part.column("b"))
                x = Links.of(v, ids_a, n_a, ids_b)
                n, _ = k.counts(v, x)
                docs, bounds = len(n_a), np.searchsorted(x.doc, np.arange(len(n_a) + 1))
                total = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])  # noqa: B023, E731
                sums = [n_a, n_b, total(x.a_ends & x.b_ends), np.diff(bounds), total((n > 0) & (n == k.best[x.a])), total(n)]
                columns = [part.column("row"), part.column("doc_id"), *(pa.array(s.astype(np.int64)) for s in sums), pa.array(rendered(x, ids_a, ids_b, n_a + n_b), pa.string())]
                assert all(len(c) == docs for c in columns)
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", *SUMS, "groups"])

    return run


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, known_pairs: int = KNOWN_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    A encodes a space and the text, B the text. groups is `a1,a2|b1;a3|b2,b3`: the ids of A and B between common ends. A
    pair's count is the number of documents that hold it linked; n_best counts links whose count is the highest of their
    id of A, ties included, count_sum adds the counts of all links. Null and empty texts, texts that are no UTF-8
    and texts that a tokenizer does not give back byte by byte have no tokens: zeros and no groups. Rows that repeat a doc_id are documents
    of their own; other columns are left out. An empty table has no rows.
    """
    spark = docs.sparkSession
    v = Vocabularies.load(byte_bpe, piece_bpe)
    shared = spark.sparkContext.broadcast(v)
    packed = tokens(docs, shared)
    counts = pair_counts(packed, shared)
    here, rare = _known(counts, v, known_pairs)
    known = spark.sparkContext.broadcast(here)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, {', '.join(f'{s} long' for s in SUMS)}, groups string"
    base = packed.mapInArrow(_report(shared, known), schema)
    if not rare.isEmpty():
        best = spark.createDataFrame([(int(a), int(here.best[a])) for a in np.flatnonzero(here.best)], "a int, best long")
        with_best = rare.withColumn("a", F.floor(F.col("pair") / len(v.bytes_b)).cast("int")).join(F.broadcast(best), "a")
        links = packed.select("row", "a", "b").mapInArrow(_rare_links(shared, known), "row long, pair long, links long").join(with_best, "pair")
        more = links.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more"))
        base = base.join(more, "row", "left").withColumns(
            {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
        )
    return base.select("doc_id", *SUMS, "groups")


ship_by_value(__name__)
