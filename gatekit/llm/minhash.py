"""SuperMinHash signatures and their bands, in numpy over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .common import ship_by_value

LEVEL_BITS = np.uint64(54)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
# Elements handled at once; bounds the memory of a worker.
ELEMENTS = 400_000


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finalizer: spreads x + salt over all bits."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def super_minhash(values: np.ndarray, lengths: np.ndarray, m: int) -> np.ndarray:
    """Signatures (sets x m, uint64) of the sets laid end to end in values.

    Every element deals the m places in an order of its own; at its j-th place it bids j plus a uniform
    draw, and a place keeps its lowest bid. All elements bid level by level, and a set stops as soon as each
    of its places has a bid, since later levels bid higher. A bid is kept as level and draw in one integer.
    """
    sets = len(lengths)
    out = np.full(sets * m, EMPTY, dtype=np.uint64)
    owner = np.repeat(np.arange(sets, dtype=np.int64), lengths)
    x = values.astype(np.uint64, copy=False)
    swaps: list[np.ndarray] = []
    for level in range(m):
        if not len(x):
            break
        draw = mixed(x, level + 1)
        place = (level + (draw >> np.uint64(32)) % np.uint64(m - level)).astype(np.int32)
        swaps.append(place)
        # The place that stands at `place` after the swaps of the earlier levels.
        at = place.copy()
        for earlier in range(level - 1, -1, -1):
            at[at == swaps[earlier]] = earlier
        bid = (np.uint64(level) << LEVEL_BITS) | (mixed(draw, 0x5BD1) >> (np.uint64(64) - LEVEL_BITS))
        np.minimum.at(out, owner * m + at, bid)
        open_sets = np.zeros(sets, dtype=bool)
        pending = np.unique(owner)
        open_sets[pending] = (out.reshape(sets, m)[pending] == EMPTY).any(axis=1)
        on = open_sets[owner]
        if not on.all():
            x, owner, swaps = x[on], owner[on], [s[on] for s in swaps]
    return out.reshape(sets, m)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, from its rows and its number."""
    rows = signatures.reshape(len(signatures), bands, -1)
    key = mixed(np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2]).copy(), 77)
    for r in range(rows.shape[2]):
        key = mixed(key ^ rows[:, :, r], r + 1)
    return key.view(np.int64)


def set_prints(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free hashes per set."""
    x = values.astype(np.uint64, copy=False)
    sums = []
    for salt in (101, 202):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(x, salt), dtype=np.uint64)])
        sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return sums[0], sums[1]


def slices(offsets: np.ndarray, elements: int = ELEMENTS) -> Iterator[tuple[int, int]]:
    """Runs of sets with about `elements` elements each, one set at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + elements, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def sketcher(m: int, bands: int, keep: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turn batches of `keep` columns and a last column of sets (list<long>) into the same columns and n, p1, p2, keys, brief.

    brief is the signature cut to the last byte of each place, eight places to a long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(keep)
            offsets = column.offsets.to_numpy().astype(np.int64)
            values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for a, b in slices(offsets):
                own = offsets[a : b + 1] - offsets[a]
                x = values[offsets[a] : offsets[b]]
                p1, p2 = set_prints(x, own)
                signatures = super_minhash(x, np.diff(own), m)
                brief = signatures.astype(np.uint8).view(np.int64)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))
                    for values in (band_keys(signatures, bands), brief)
                ]
                arrays = [batch.column(i).slice(a, b - a) for i in range(keep)]
                names = batch.schema.names[:keep] + ["n", "p1", "p2", "keys", "brief"]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.diff(own)), pa.array(p1), pa.array(p2), *lists], names=names)

    return run


ship_by_value(__name__)
