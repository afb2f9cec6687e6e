"""Patterns over source code with metavariables, terms for an index, and elements of Python files.

Matching works on tokens, not on syntax trees: no parser generator is at hand. A pattern is
code in which \\NAME stands for one token or one bracketed group, \\_ for any such, \\(X*\\)
for any run of them within one bracket level, \\(X?\\) for one or none, \\(X:/re/\\) for a
token that the expression fits, and \\{{ ... \\}} for a part that must be somewhere in a
following bracketed group. The same name must match the same tokens.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"#[^\n]*|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[^\W\d]\w*|\d[\w.]*|=>|->|::|[<>=!]=|&&|\|\||[^\w\s]")
_META = re.compile(r"\\\((?P<run>\w+)(?P<many>[*?])\\\)|\\\((?P<named>\w+):/(?P<re>(?:\\/|[^/])*)/\\\)|\\(?P<name>[A-Za-z]\w*|_)|(?P<open>\\\{\{)|(?P<close>\\\}\})")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def tokens(source: str) -> list[tuple[str, int, int]]:
    """(token, start, end) without comments."""
    return [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(source) if not m.group().startswith(("#", "//"))]


@dataclass(frozen=True)
class _Part:
    kind: str  # token, one, many, maybe, regex, inside
    text: str
    inner: tuple = ()


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    text: str
    bindings: dict[str, str]


class CodePattern:
    """A compiled pattern; `min_len` is the length from which literal words are used to rule texts out."""

    def __init__(self, pattern: str, language: str | None = None, min_len: int = 3):
        self.pattern, self.language, self.min_len = pattern, language, min_len
        self._parts, rest = self._parse(pattern, 0, False)
        if rest != len(pattern):
            raise ValueError("containment is closed but never opened")
        self.literals = sorted({p.text for p in self._walk(self._parts) if p.kind == "token" and len(p.text) >= min_len and re.fullmatch(r"\w+", p.text)})

    def _walk(self, parts) -> Iterator[_Part]:
        for p in parts:
            yield p
            yield from self._walk(p.inner)

    def _parse(self, text: str, at: int, nested: bool) -> tuple[tuple[_Part, ...], int]:
        out: list[_Part] = []
        while at < len(text):
            m = _META.match(text, at)
            if m and m.lastgroup:
                at = m.end()
                if m["open"]:
                    inner, at = self._parse(text, at, True)
                    out.append(_Part("inside", "", inner))
                elif m["close"]:
                    if not nested:
                        return tuple(out), m.start()
                    return tuple(out), at
                elif m["run"]:
                    out.append(_Part("many" if m["many"] == "*" else "maybe", m["run"]))
                elif m["named"]:
                    out.append(_Part("regex", m["named"], (_Part("re", m["re"].replace("\\/", "/")),)))
                else:
                    out.append(_Part("one", m["name"]))
                continue
            if text[at].isspace():
                at += 1
                continue
            t = _TOKEN.match(text, at)
            if not t:
                raise ValueError(f"cannot read the pattern at {at}")
            out.append(_Part("token", t.group()))
            at = t.end()
        if nested:
            raise ValueError("containment is not closed")
        return tuple(out), at

    def might_match(self, source: str) -> bool:
        return all(w in source for w in self.literals)

    def prefilter(self, source: Column) -> Column:
        """The same as a column, to stand before the Python part of a plan."""
        out = F.lit(True)
        for w in self.literals:
            out = out & F.contains(source, F.lit(w))
        return out

    def match_source(self, source: str) -> list[Match]:
        """Matches from left to right that do not overlap."""
        if not self.might_match(source):
            return []
        toks = tokens(source)
        close = _closing(toks)
        out, i = [], 0
        while i < len(toks):
            got = next(_fit(self._parts, 0, toks, close, i, {}), None)
            if got and got[0] > i:
                end, names = got
                out.append(Match(toks[i][1], toks[end - 1][2], source[toks[i][1] : toks[end - 1][2]], {k: source[toks[a][1] : toks[b - 1][2]] if b > a else "" for k, (a, b) in names.items()}))
                i = end
            else:
                i += 1
        return out


def _closing(toks: list[tuple[str, int, int]]) -> dict[int, int]:
    stack, out = [], {}
    for i, (t, _, _) in enumerate(toks):
        if t in _PAIRS:
            stack.append(i)
        elif stack and t == _PAIRS[toks[stack[-1]][0]]:
            out[stack.pop()] = i
    return out


def _unit(toks, close, i: int) -> int | None:
    """The end of the token or bracketed group at i; None at a closing bracket or the end."""
    if i >= len(toks) or toks[i][0] in ")]}":
        return None
    return close[i] + 1 if i in close else i + 1


def _bind(names: dict, name: str, a: int, b: int, toks) -> dict | None:
    if name == "_":
        return names
    if name in names:
        x, y = names[name]
        return names if [t[0] for t in toks[x:y]] == [t[0] for t in toks[a:b]] else None
    return names | {name: (a, b)}


def _fit(parts, k: int, toks, close, i: int, names: dict) -> Iterator[tuple[int, dict]]:
    if k == len(parts):
        yield i, names
        return
    p = parts[k]
    if p.kind == "token":
        if i < len(toks) and toks[i][0] == p.text:
            yield from _fit(parts, k + 1, toks, close, i + 1, names)
    elif p.kind in ("one", "regex"):
        end = _unit(toks, close, i)
        if end and (p.kind == "one" or (end == i + 1 and re.fullmatch(p.inner[0].text, toks[i][0]))):
            got = _bind(names, p.text, i, end, toks)
            if got is not None:
                yield from _fit(parts, k + 1, toks, close, end, got)
    elif p.kind == "inside":
        end = close.get(i)
        if end is not None:
            for j in range(i + 1, end):
                hit = next((h for h in _fit(p.inner, 0, toks, close, j, names) if h[0] <= end), None)
                if hit:
                    yield from _fit(parts, k + 1, toks, close, end + 1, hit[1])
                    return
    else:  # the shortest run that lets the rest fit
        end, most = i, 1 if p.kind == "maybe" else len(toks)
        for _ in range(most + 1):
            got = _bind(names, p.text, i, end, toks)
            if got is not None:
                yield from _fit(parts, k + 1, toks, close, end, got)
            step = _unit(toks, close, end)
            if step is None:
                return
            end = step


def match_code(pattern: str, source: str, language: str | None = None) -> list[Match]:
    return CodePattern(pattern, language).match_source(source)


def match_column(df: DataFrame, key: str, text: str, pattern: CodePattern) -> DataFrame:
    """(key, start, end, text, bindings) of every match in every row; rows without the pattern's words never reach Python."""
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(pattern.prefilter(F.col("text")))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for m in pattern.match_source(t or ""):
                    owners.append(i)
                    rows.append(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owners, pa.int64())), pa.array([m.start for m in rows], pa.int64()), pa.array([m.end for m in rows], pa.int64()), pa.array([m.text for m in rows], pa.string()), pa.array([list(m.bindings.items()) for m in rows], pa.map_(pa.string(), pa.string()))],
                ["key", "start", "end", "text", "bindings"],
            )

    return own.mapInArrow(find, f"key {own.schema['key'].dataType.simpleString()}, start bigint, end bigint, text string, bindings map<string,string>").withColumnRenamed("key", key)


def index_terms(source: Column, min_len: int = 3) -> Column:
    """Distinct identifiers of a source text, sorted, of `min_len` characters at least."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0), lambda t: F.length(t) >= min_len)))


def python_elements(source: str) -> list[dict]:
    """Declarations (class, function) and references (call, import) of a Python file; none if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        kind = name = None
        if isinstance(node, ast.ClassDef):
            kind, name = "class", node.name
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            kind, name = "function", node.name
        elif isinstance(node, ast.Call):
            f = node.func
            kind, name = "call", f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        elif isinstance(node, ast.Import | ast.ImportFrom):
            kind, name = "import", ", ".join(a.name for a in node.names)
        if kind and name:
            out.append({"kind": kind, "name": name, "line": node.lineno})
    return sorted(out, key=lambda e: (e["line"], e["kind"], e["name"]))


def render_match(source: str, match: Match, context: int = 1) -> str:
    """The lines of a match with some before and after, numbered; matched lines are marked."""
    lines = source.split("\n")
    a, b = source.count("\n", 0, match.start), source.count("\n", 0, match.end)
    return "\n".join(f"{'>' if a <= i <= b else ' '} {i + 1:4d} {lines[i]}" for i in range(max(0, a - context), min(len(lines), b + context + 1)))
