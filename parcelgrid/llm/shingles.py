"""Distinct word shingles of texts as 64-bit numbers, and exact comparison of such sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from parcelgrid.llm.arrow import coded, strings, words

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    x = (x ^ (x >> np.uint64(29))) * _ODD[1]
    return x ^ (x >> np.uint64(32))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all rows one after another, offsets per row).

    A shingle is ``size`` words in a row, A-Z in lower case; a row with fewer
    words has its whole sequence as the only one, a row without words none.
    """
    flat, at = words(column, lower=True)
    codes, names = coded(flat)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, strings(names)), np.uint64, len(names))
    h = hashes[codes]
    n = len(h)
    whole = mixed(h)
    for k in range(1, size):
        whole[: n - k] = mixed(whole[: n - k] * _ODD[2] + h[k:])
        whole[n - k:] = 0
    out, ends = [], [0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            s = np.unique(whole[a: b - size + 1])
        elif b > a:
            s = h[a: a + 1] * np.uint64(2 * (b - a) + 1)
            for k in range(a + 1, b):
                s = mixed(s * _ODD[2] + h[k])
            s = mixed(s)
        else:
            s = h[:0]
        out.append(s)
        ends.append(ends[-1] + len(s))
    return (np.concatenate(out) if out else h[:0]), np.array(ends, np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    i = np.searchsorted(b, a)
    i[i == len(b)] = 0
    return int((b[i] == a).sum())
