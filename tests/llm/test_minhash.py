"""The vectorised signatures against the element-by-element definition."""

import numpy as np
from gatekit.llm.minhash import band_keys, mixed, super_minhash
from gatekit.llm.ngram_lm import pack, unpack


def one_by_one(values, m):
    lowest = [None] * m
    for v in values:
        order = list(range(m))
        for j in range(m):
            draw = mixed(np.array([v], dtype=np.uint64), j + 1)
            k = j + int((draw[0] >> np.uint64(32)) % np.uint64(m - j))
            order[j], order[k] = order[k], order[j]
            bid = (j << 54) | int(mixed(draw, 0x5BD1)[0] >> np.uint64(10))
            if lowest[order[j]] is None or bid < lowest[order[j]]:
                lowest[order[j]] = bid
    return lowest


def test_levels_equal_the_definition():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 2, 7, 0, 40, 300])
    values = rng.integers(0, 2**63, lengths.sum()).astype(np.uint64)
    got, at = super_minhash(values, lengths, 16), 0
    for row, n in zip(got, lengths, strict=True):
        if n:
            assert list(map(int, row)) == one_by_one(values[at : at + n], 16)
        at += n


def test_variance_is_below_that_of_minhash():
    rng = np.random.default_rng(2)
    n, jaccard, share = 300, 0.85, []
    both = int(2 * n * jaccard / (1 + jaccard))
    for _ in range(200):
        x = rng.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        s = super_minhash(np.concatenate([x[:n], x[n - both :]]), np.array([n, n]), 256)
        share.append((s[0] == s[1]).mean())
    true = both / (2 * n - both)
    assert abs(np.mean(share) - true) < 0.005 and np.std(share) < 0.9 * np.sqrt(true * (1 - true) / 256)


def test_bands_depend_on_all_rows():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 2**63, (2, 32)).astype(np.uint64)
    s[1] = s[0]
    s[1, 5] += np.uint64(1)
    a, b = band_keys(s, 8)
    assert (a != b).tolist() == [False, True] + [False] * 6


def test_pack_round_trip():
    rng = np.random.default_rng(4)
    for n in (0, 1, 1000):
        columns = [rng.integers(0, top, n).astype(np.uint64) for top in (2, 300, 2**48)]
        assert all((a == b).all() for a, b in zip(columns, unpack(pack(columns)), strict=True))
