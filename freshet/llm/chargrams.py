"""Hashed character n-grams of texts as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from freshet.llm.textkit import by_bytes

_GAP = "\n\n\n"  # one less than the longest n-gram: no n-gram reaches into the next text
LONGEST = 4
PIECE = 1 << 20  # characters of a text handled at once
_MULT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a gap after each, and n + 1 bounds (a text with its gap)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + len(_GAP)
    joined = "".join(t + _GAP for t in texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.concatenate(([0], np.cumsum(size)))


def grams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each code point but the last n - 1."""
    m = max(0, len(points) - n + 1)
    out = np.full(m, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        out ^= points[k : k + m] * np.uint32(_MULT[k])
        out *= np.uint32(0x2545F491)
        out ^= out >> np.uint32(15)
    return (out >> np.uint32(32 - bits)).astype(np.int32)


def pieces(texts: list[str], size: int | None = None) -> Iterator[tuple[int, list[str], np.ndarray]]:
    """(first text, texts, starts that count in each): texts as they are, but a long one in pieces that overlap, so that every n-gram starts in one of them."""
    size = size or PIECE
    i = 0
    while i < len(texts):
        j = i
        while j < len(texts) and len(texts[j]) <= size:
            j += 1
        if j > i:
            yield i, texts[i:j], np.fromiter(map(len, texts[i:j]), np.int64, j - i)
            i = j
            continue
        for a in range(0, len(texts[i]), size):
            yield i, [texts[i][a : a + size + LONGEST - 1]], np.array([min(size, len(texts[i]) - a)])
        i += 1


def text_parts(batch: pa.RecordBatch, column: int = 1, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with at most `limit` bytes of text, or one text, and their texts; null is empty."""
    for part in by_bytes(batch, limit, column):
        yield part, [t or "" for t in part.column(column).to_pylist()]
