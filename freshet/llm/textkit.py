"""Words of UTF-8 text as numpy arrays of 64-bit hashes, without a Python object per word.

A word is a longest run of ASCII letters and digits and of bytes above 127, after A-Z
became a-z: the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on lower-cased text.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 512 << 10  # bytes handled at once; memory is about 60 times as much
_BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1

FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    if _b > 127 or (_c.isascii() and _c.isalnum()):
        FOLD[_b] = ord(_c.lower()) if _b < 128 else _b


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], filled = 1, 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES["pow"]) < n:
        size = max(n, SEGMENT + 1)
        _TABLES["pow"] = _powers(_BASE, size)
        _TABLES["inv"] = _powers(pow(_BASE, -1, 1 << 64), size)
    return _TABLES["pow"], _TABLES["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each value of a uint64 array over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and n + 1 offsets into them; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offs else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def tidy(work: Callable) -> Callable:
    """A batch function that gives memory back to the system when its task ends: Python workers are used again by other stages."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library than glibc
                pass

    return run


class Memory:
    """Values of the texts asked for last, between `most` and twice as many; texts of more than 64 characters are computed anew each time."""

    def __init__(self, most: int):
        self.most, self._now, self._before = most, {}, {}

    def forget(self) -> None:
        self._now, self._before = {}, {}

    def values(self, keys: list[str], compute: Callable[[list[str]], Iterable]) -> list:
        """The value of each key; compute(keys) gives those that are not remembered, none of them None."""
        now, before = self._now, self._before
        out = list(map(now.get, keys))
        fresh = []
        for i in [i for i, value in enumerate(out) if value is None]:
            out[i] = before.get(keys[i])
            if out[i] is None:
                fresh.append(i)
            else:
                now[keys[i]] = out[i]
        for i, value in zip(fresh, compute([keys[i] for i in fresh]), strict=True):
            out[i] = value
            if len(keys[i]) <= 64:
                now[keys[i]] = value
        if len(now) > self.most:
            self._before, self._now = now, {}
        return out


def by_bytes(batch: pa.RecordBatch, limit: int = 6 << 20, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text, or one row."""
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def segments(raw: np.ndarray, at: np.ndarray, limit: int = SEGMENT) -> Iterator[tuple[int, int, int, int, bool]]:
    """(first doc, last doc + 1, first byte, last byte + 1, more of that doc follows).

    Several short documents share a segment; a longer one is cut between words.
    """
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + limit, "right")) - 1
        if j > i:
            yield i, j, int(at[i]), int(at[j]), False
            i = j
            continue
        lo, end = int(at[i]), int(at[i + 1])
        while end - lo > limit:
            cut = lo + limit
            while True:  # back to the last byte that is in no word, else on to the next one
                gaps = np.flatnonzero(FOLD[raw[lo:cut]] == 0)
                if len(gaps) or cut >= end:
                    break
                cut = min(end, cut + limit)
            cut = lo + int(gaps[-1]) + 1 if len(gaps) else end
            yield i, i + 1, lo, cut, cut < end
            lo = cut
        if lo < end:
            yield i, i + 1, lo, end, False
        i += 1


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, starts and ends of words (from the first byte of `raw`) and the first word of each document."""
    folded = FOLD[raw]
    inside = folded != 0
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    before = np.concatenate(([False], inside[:-1])) if len(raw) else inside
    after = np.concatenate((inside[1:], [False])) if len(raw) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return folded, starts, ends, np.searchsorted(starts, at)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and n + 1 bounds of the documents in them."""
    raw, at = buffers(texts)
    parts: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    for i, j, lo, hi, _ in segments(raw, at):
        inner = np.clip(at[i : j + 1], lo, hi) - lo
        folded, s, e, bound = spans(raw[lo:hi], inner)
        pw, inv = _tables(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(folded * pw[: hi - lo], out=total[1:])
        h = (total[e] - total[s]) * inv[s]
        parts.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        counts[i:j] += np.diff(bound)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words within documents, and the documents' bounds in them.

    A document of fewer than n words, but of one at least, has one shingle: all its words.
    """
    size = np.diff(bounds)
    have = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(have)))
    length = len(words)
    if not length:
        return np.zeros(0, np.uint64), out_bounds
    padded = np.concatenate((words, np.zeros(n - 1, np.uint64)))
    run = np.zeros(length, np.uint64)
    for k in range(n):
        run *= np.uint64(0x9FB21C651E98DF25)
        run += padded[k : k + length]
    short = np.flatnonzero((size > 0) & (size < n))
    for d in short:  # n - 1 words at most
        h = 0
        for w in words[bounds[d] : bounds[d + 1]]:
            h = (h * 0x9FB21C651E98DF25 + int(w)) & _M64
        run[bounds[d]] = (h ^ (0xA5A5A5A5 + int(size[d]))) & _M64
    keep = np.repeat(bounds[:-1] - out_bounds[:-1], have) + np.arange(out_bounds[-1])
    return mix(run[keep]), out_bounds
