"""Python functions over rows: batched, retried in smaller batches, paced, with failures set aside."""

from __future__ import annotations

import ast
import hashlib
import inspect
import random
import textwrap
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class RetryWithSmallerBatch(Exception):
    """Raised by a batch function that wants fewer items at once."""


def run_batch(fn: Callable[[list], list], items: list) -> list[tuple[object, str | None]]:
    """(result, error) of each item; a batch that fails is halved until the item that fails stands alone."""
    if not items:
        return []
    try:
        out = fn(items)
        if len(out) != len(items):
            raise ValueError(f"{len(items)} items, {len(out)} results")
        return [(r, None) for r in out]
    except Exception as error:  # noqa: BLE001
        if len(items) == 1:
            return [(None, f"{type(error).__name__}: {error}")]
        half = len(items) // 2
        return run_batch(fn, items[:half]) + run_batch(fn, items[half:])


class RateLimiter:
    """At most `rate` units a second in this task, `burst` at once."""

    def __init__(self, rate: float, burst: float = 1.0, clock=time.monotonic, sleep=time.sleep):
        self._rate, self._burst, self._clock, self._sleep = rate, burst, clock, sleep
        self._left, self._at = burst, clock()

    def acquire(self, units: float = 1.0) -> None:
        now = self._clock()
        self._left = min(self._burst, self._left + (now - self._at) * self._rate)
        self._at = now
        if self._left < units:
            self._sleep((units - self._left) / self._rate)
            self._at = self._clock()
            self._left = units
        self._left -= units


def exponential_backoff(attempt: int, base: float = 0.5, most: float = 30.0, jitter: Callable[[], float] = random.random) -> float:
    return min(most, base * 2**attempt) * (0.5 + jitter() / 2)


def retry_transient(fn: Callable[[], object], transient: tuple[type[Exception], ...], attempts: int = 5, deadline_s: float | None = None, sleep=time.sleep, clock=time.monotonic):
    """fn(), again after transient errors, until attempts or the time are used up."""
    end = None if deadline_s is None else clock() + deadline_s
    for k in range(attempts):
        try:
            return fn()
        except transient:
            wait = exponential_backoff(k)
            if k == attempts - 1 or (end is not None and clock() + wait > end):
                raise
            sleep(wait)
    raise AssertionError


def map_rows(df: DataFrame, column: str, fn: Callable[[list], list], result: str, kind: str, *, max_batch: int = 64, per_second: float | None = None) -> DataFrame:
    """`df` with `result` and `error`: fn takes a list of values and returns as many results. A failure is a row with an error, not a failed job."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{result}` {kind}, error string"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(per_second, per_second) if per_second else None
        for pdf in batches:
            values, out = pdf[column].tolist(), []
            for lo in range(0, len(values), max_batch):
                if limiter:
                    limiter.acquire()
                out += run_batch(fn, values[lo : lo + max_batch])
            yield pdf.assign(**{result: [r for r, _ in out], "error": [e for _, e in out]})

    return df.mapInPandas(work, schema)


def logic_fingerprint(fn: Callable, version: str | None = None, deps: tuple[Callable | str, ...] = ()) -> str:
    """Digest of a function's code without comments, docstrings, decorators and layout, or of `version`; and of what it depends on."""
    if version is not None:
        own = f"version:{version}"
    else:
        node = ast.parse(textwrap.dedent(inspect.getsource(fn))).body[0]
        node.decorator_list = []
        for n in ast.walk(node):
            body = getattr(n, "body", None)
            if isinstance(body, list) and body and isinstance(body[0], ast.Expr) and isinstance(getattr(body[0], "value", None), ast.Constant) and isinstance(body[0].value.value, str):
                n.body = body[1:] or [ast.Pass()]
        own = ast.dump(node, annotate_fields=False, include_attributes=False)
    parts = [own] + sorted(d if isinstance(d, str) else logic_fingerprint(d) for d in deps)
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


class NotMemoKeyable(TypeError):
    """A value that has no stable key."""


def memo_key(value: object) -> str:
    """Digest of a value: kinds stay apart, lists and tuples are alike, the order of dicts and sets does not matter."""

    def show(v: object) -> str:
        if v is None or isinstance(v, bool | int | str | bytes):
            return f"{type(v).__name__}:{v!r}"
        if isinstance(v, float):
            return f"float:{v.hex()}"
        if isinstance(v, list | tuple):
            return "[" + ",".join(map(show, v)) + "]"
        if isinstance(v, set | frozenset):
            return "{" + ",".join(sorted(map(show, v))) + "}"
        if isinstance(v, dict):
            return "{" + ",".join(sorted(f"{show(k)}={show(x)}" for k, x in v.items())) + "}"
        if hasattr(v, "__memo_key__"):
            return f"{type(v).__qualname__}:{show(v.__memo_key__())}"
        if hasattr(v, "__dataclass_fields__"):
            return f"{type(v).__qualname__}:{show({n: getattr(v, n) for n in v.__dataclass_fields__})}"
        raise NotMemoKeyable(type(v).__qualname__)

    return hashlib.sha256(show(value).encode()).hexdigest()


def map_stream(df: DataFrame, column: str, fn: Callable[[list], list], kind: str = "string", **options) -> Iterator[tuple]:
    """(value, result, error) one after the other, as partitions end; only one partition of results is held."""
    for r in map_rows(df.select(column), column, fn, "__result", kind, **options).toLocalIterator(prefetchPartitions=True):
        yield r[column], r["__result"], r["error"]
