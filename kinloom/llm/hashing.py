"""64-bit hashes of all words of Arrow batches of texts, worked out on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPAN = 1 << 16  # bytes that are hashed at once

FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.multiply.accumulate(np.full(n, base, "u8"))]


# a word's hash is the sum of its bytes' values times powers of an odd number, which sums over the text give at once
_BASE = 0x9FB21C651E98DF25
_POWER, _INVERSE = _powers(_BASE, SPAN), _powers(pow(_BASE, -1, 1 << 64), SPAN)
_lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], "u8")
_BYTE = mix64((_lower + np.uint64(1)) * FACTORS[0])
_BLANK = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])


@np.errstate(over="ignore")
def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[at[i]:at[i + 1]]`` (UTF-8, A-Z as a-z), and each text's number of words."""
    n = len(data)
    if not n:
        return np.empty(0, "u8"), np.zeros(len(at) - 1, "int64")
    word = ~_BLANK[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edge = np.unique(at)
    first[edge[:-1]] = word[edge[:-1]]
    last[edge[1:] - 1] = word[edge[1:] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    before, upto = np.empty(len(begin), "u8"), np.empty(len(begin), "u8")
    back = np.empty(len(begin), "u8")
    so_far, up, down = np.uint64(0), np.uint64(1), np.uint64(1)
    for lo in range(0, n, SPAN):
        m = min(SPAN, n - lo)
        x = _BYTE[data[lo : lo + m]]
        x *= _POWER[:m]
        x *= up
        sums = np.cumsum(x, dtype="u8")
        sums += so_far
        i, j = np.searchsorted(begin, (lo, lo + m))
        here = begin[i:j] - lo
        before[i:j] = sums[here] - x[here]
        back[i:j] = _INVERSE[here] * down
        i, j = np.searchsorted(end, (lo, lo + m))
        upto[i:j] = sums[end[i:j] - lo]
        so_far, up, down = sums[-1], up * _POWER[SPAN], down * _INVERSE[SPAN]
    return mix64((upto - before) * back), np.diff(np.searchsorted(begin, at))


def runs(texts: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) of runs of texts of at most ``most`` bytes, or of one text; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    kind = "i8" if pa.types.is_large_string(texts.type) else "i4"
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype("int64")
    data = np.frombuffer(data, "u1") if data else np.empty(0, "u1")
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))
