"""Models as column functions: embedders, transcribers, pair resolvers and local models are given as Python objects and called in batches."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from freshet.operators.entity import Resolution
from freshet.operators.tasks import map_rows


class Embedder(Protocol):
    """Texts to vectors of one length."""

    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


#: The 256 values of the table-driven CRC-32.
_CRC = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


class HashEmbedder:
    """Hashed character n-grams: deterministic, no files, for tests and as a baseline."""

    def __init__(self, dimension: int = 64, n: int = 3, normalize: bool = True):
        self.dimension, self.n, self.normalize = dimension, n, normalize

    def _hashes(self, raw: bytes) -> np.ndarray:
        """CRC-32 of every run of n characters, a byte of all runs at a time."""
        data = np.frombuffer(raw, np.uint8)
        bound = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        at, size = bound[: -self.n], bound[self.n :] - bound[: -self.n]
        crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
        for k in range(size.max(initial=0)):
            on = size > k
            now = crc[on]
            crc[on] = _CRC[(now ^ data[at[on] + k]) & 0xFF] ^ (now >> np.uint32(8))
        return (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for row, t in zip(out, texts, strict=True):
            h = self._hashes(f" {(t or '').lower()} ".encode())
            row[:] = np.bincount(h % self.dimension, np.where(h & 0x80000000, 1.0, -1.0), self.dimension)
        if self.normalize:
            size = np.linalg.norm(out, axis=1, keepdims=True)
            out = np.divide(out, size, out=out, where=size > 0)
        return out.tolist()


def embed(text: Column, factory: Callable[[], Embedder], batch: int = 64) -> Column:
    """A column of vectors. `factory` runs once a task, so a model is loaded once; equal neighbours in a batch are embedded once."""

    @pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in parts:
            codes, distinct = pd.factorize(texts.fillna(""))
            vectors = [v for lo in range(0, len(distinct), batch) for v in model.embed(list(distinct[lo : lo + batch]))]
            yield pd.Series([vectors[c] for c in codes])

    return run(text)


def call_model(df: DataFrame, column: str, fn: Callable[[list], list], result: str = "result", kind: str = "string", **options) -> DataFrame:
    """`df` with a model's answers: batches of at most 64, halved where one fails; see operators.tasks.map_rows."""
    return map_rows(df, column, fn, result, kind, **({"max_batch": 64} | options))


class PairResolver:
    """Resolves names by a model's answer: `ask(name, candidates)` returns a candidate, or anything else for none. Asked again up to `retries` times while it answers what is no candidate."""

    def __init__(self, ask: Callable[[str, list[str]], str | None], retries: int = 2):
        self._ask, self._retries = ask, retries

    def __call__(self, name: str, candidates: list[str]) -> Resolution:
        for _ in range(self._retries + 1):
            answer = self._ask(name, candidates)
            if answer is None or answer in candidates:
                return Resolution(answer)
        return Resolution(None)


def nul_free(df: DataFrame) -> DataFrame:
    """`df` with U+0000 taken out of its text columns, which databases refuse."""
    return df.select(*[F.translate(F.col(f"`{n}`"), "\u0000", "").alias(n) if k == "string" else F.col(f"`{n}`") for n, k in df.dtypes])
