"""Splitting, tokens, sections and languages of texts."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ASCII_SPACE = " \t\n\r\x0b\x0c"
POSITION = "struct<byte_offset:bigint,char_offset:bigint,line:bigint,column:bigint>"
CHUNK = f"array<struct<text:string,start:{POSITION},end:{POSITION}>>"


class Positions:
    """Byte offset, line and column (both from 1) of character offsets in a text."""

    def __init__(self, text: str):
        self._text, self._plain = text, text.isascii()
        self._lines = [0] + [m.end() for m in re.finditer("\n", text)]
        self._known = [(0, 0)]

    def byte(self, at: int) -> int:
        if self._plain:
            return at
        k = bisect_right(self._known, (at, float("inf"))) - 1
        c, b = self._known[k]
        b += len(self._text[c:at].encode())
        if k == len(self._known) - 1:
            self._known.append((at, b))
        return b

    def at(self, offset: int) -> dict[str, int]:
        line = bisect_right(self._lines, offset)
        return {"byte_offset": self.byte(offset), "char_offset": offset, "line": line, "column": offset - self._lines[line - 1] + 1}


@dataclass(frozen=True)
class SeparatorSplitter:
    """Cuts a text at every match of any of the patterns, which see it line by line (^ and $).

    keep_separator None drops what matched, "left" leaves it with the piece before, "right"
    with the one after. Pieces lose ASCII white space at both ends if `trim`, and are dropped
    if nothing is left, unless `include_empty`. Without patterns the text is one piece.
    """

    separators: tuple[str, ...]
    keep_separator: str | None = None
    include_empty: bool = False
    trim: bool = True

    def spans(self, text: str) -> list[tuple[int, int]]:
        cuts = [(m.start(), m.end()) for m in re.finditer("|".join(f"(?:{s})" for s in self.separators), text, re.M)] if self.separators else []
        ends = [e if self.keep_separator == "left" else s for s, e in cuts] + [len(text)]
        starts = [0] + [s if self.keep_separator == "right" else e for s, e in cuts]
        out = []
        for a, b in zip(starts, ends, strict=True):
            if self.trim:
                piece = text[a:b]
                a, b = b - len(piece.lstrip(_ASCII_SPACE)), a + len(piece.rstrip(_ASCII_SPACE))
                b = max(a, b)
            if b > a or self.include_empty:
                out.append((a, b))
        return out

    def split(self, text: str) -> list[dict]:
        return _chunks(text, self.spans(text))


def _chunks(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    where = Positions(text)
    return [{"text": text[a:b], "start": where.at(a), "end": where.at(b)} for a, b in spans]


#: Separators from coarse to fine: fixed values.
DEFAULT_SEPARATORS = (r"\n\n+", r"\n", r"[\.\?!]\s+|。|？|！", r"[;:\-—]\s+|；|：|—+", r",\s+|，", r"\s+")


#: What comes before the default separators, by language: where its larger parts begin.
_BRACES = (r"(?<=\n\})[;,]?\s*\n", r"\n(?=(?:[ \t]*(?:(?:pub|public|private|protected|internal|static|export|abstract|final|async|override|virtual)\s+)*(?:fn|func|function|fun|def|class|struct|enum|interface|trait|impl|object|namespace|module|contract|type)\b))")
LANGUAGE_SEPARATORS = {
    **dict.fromkeys("c cpp csharp cuda dart go groovy java javascript kotlin php proto rust scala solidity swift thrift tsx typescript".split(), _BRACES),
    "python": (r"\n(?=(?:async[ \t]+def|def|class|@)\b|@)", r"\n(?=[ \t]+(?:async[ \t]+def|def|class)\b)"),
    "ruby": (r"\n(?=(?:class|module|def)\b)", r"\n(?=[ \t]+(?:class|module|def)\b)"),
    "elixir": (r"\n(?=defmodule\b)", r"\n(?=[ \t]+defp?\b)"),
    "lua": (r"\n(?=(?:local[ \t]+)?function\b)",),
    "r": (r"\n(?=[\w.]+[ \t]*<-[ \t]*function\b)",),
    "bash": (r"\n(?=(?:function[ \t]+)?\w+[ \t]*\(\))",),
    "sql": (r"(?<=;)[ \t]*\n",),
    "markdown": (r"\n(?=# )", r"\n(?=## )", r"\n(?=#{3,6} )"),
    **dict.fromkeys(("html", "vue", "svelte", "xml"), (r"(?=<(?:body|section|article|main|h1|h2)\b)", r"(?=<(?:h[3-6]|p|div|table|ul|ol|pre)\b)", r"(?<=>)\s+")),
    "yaml": (r"\n(?=---)", r"\n(?=\w)"),
    "toml": (r"\n(?=\[)",),
    **dict.fromkeys(("css", "hcl"), (r"(?<=\})\s*\n",)),
}


@dataclass(frozen=True)
class CustomLanguageConfig:
    """Separators, from coarse to fine, for a language of one's own."""

    language_name: str
    separators_regex: tuple[str, ...]
    aliases: tuple[str, ...] = ()


class _Atoms(NamedTuple):
    """The atoms of a text, an array a property."""

    start: array
    end: array
    first: array  # byte offsets of start and end
    last: array
    depth: array  # how many separators were used to cut it out
    cut: array  # depth of the coarsest cut between the atom before and this one
    lines: array  # 0 within a line, 1 a line break, 2 an empty line: between the atom before and this one
    inner: array  # the same, of breaks inside the atom


_UNIT, _LINE, _SMALL = 512, 64, 1 << 20  # costs: fixed values
_CELLS = 1 << 18  # atoms of the texts that are joined at once, the shorter ones filled up
_AT_ONCE = 8 << 20  # characters of the texts that a task splits at once
_EMPTY_LINE = re.compile(r"\n[ \t\r]*\n")


def _steps(coarse: int, fine: int) -> int:
    return sum(_UNIT // j for j in range(1, coarse - fine + 1))


class RecursiveSplitter:
    """Cuts a text into chunks of at most `chunk_size` bytes that end at cuts as coarse as can be.

    The text is first cut into atoms, coarse separators first, until a piece has no more than
    `min_chunk_size` bytes (or than the overlap, if there is one). Then the cheapest way to
    join atoms into chunks is found: chunks that hide a coarser cut than those at their ends
    cost, so do those that hide empty lines, and above all those below `min_chunk_size`.
    """

    def __init__(self, custom_languages: tuple[CustomLanguageConfig, ...] = ()):
        self._languages: dict[str, CustomLanguageConfig] = {}
        for c in custom_languages:
            for name in (c.language_name, *c.aliases):
                if name.lower() in self._languages:
                    raise ValueError(f"language name or alias {name} is given twice")
                self._languages[name.lower()] = c

    @staticmethod
    def _atoms(text: str, patterns: list[re.Pattern], limit: int) -> _Atoms:
        plain, deepest = text.isascii(), len(patterns)
        found: list[tuple[int, int, int, int]] = []
        todo = [(0, len(text), 0, 0)]
        while todo:  # in order of the text
            a, b, depth, cut = todo.pop()
            if depth == deepest or (b - a if plain else len(text[a:b].encode())) <= limit:
                found.append((a, b, depth, cut))
                continue
            parts, at = [], a
            for m in patterns[depth].finditer(text, a, b):
                parts.append((at, m.start(), depth + 1, depth))
                at = m.end()
            parts.append((at, b, depth + 1, depth))
            parts[0] = (*parts[0][:3], cut)
            todo += parts[::-1]
        rows: list[tuple[int, ...]] = []
        before, coarse, byte = 0, 0, 0
        for a, b, depth, cut in found:
            if cut < coarse:
                coarse = cut
            piece = text[a:b]
            inside = piece.strip()
            if not inside:
                continue
            if len(inside) < b - a:
                a, b = b - len(piece.lstrip()), a + len(piece.rstrip())
            gap = text[before:a]
            breaks = gap.count("\n")
            if breaks:  # keep the indentation of a line's first atom
                a = before + len(gap.rstrip(" \t"))
            first = a if plain else byte + len(text[before:a].encode())
            byte = b if plain else first + len(text[a:b].encode())
            rows.append((a, b, first, byte, depth, coarse, min(2, breaks), 0 if "\n" not in inside else 2 if _EMPTY_LINE.search(inside) else 1))
            before, coarse = b, deepest
        return _Atoms(*[array("q", v) for v in zip(*rows, strict=True)]) if rows else _Atoms(*[array("q")] * 8)

    def _separators(self, language: str) -> tuple[str, ...]:
        """Those of a custom language, or the defaults after what a known language (or extension) has before them."""
        if language in self._languages:
            return self._languages[language].separators_regex
        return (*LANGUAGE_SEPARATORS.get(language, LANGUAGE_SEPARATORS.get(language_table().get(language, ""), ())), *DEFAULT_SEPARATORS)

    def split(self, text: str, chunk_size: int, min_chunk_size: int | None = None, chunk_overlap: int | None = None, language: str | None = None) -> list[dict]:
        return self.split_all([text], chunk_size, min_chunk_size, chunk_overlap, language)[0]

    def split_all(self, texts: list[str], chunk_size: int, min_chunk_size: int | None = None, chunk_overlap: int | None = None, language: str | None = None) -> list[list[dict]]:
        """The chunks of each text; many texts are joined together in far less time than one by one."""
        smallest = min_chunk_size if min_chunk_size is not None else chunk_size // 2
        overlap = min(chunk_overlap or 0, smallest)
        patterns = [re.compile(s) for s in self._separators((language or "").lower())]
        atoms = [self._atoms(t, patterns, overlap or smallest) for t in texts]
        out: list[list[dict]] = [[] for _ in texts]
        todo = sorted((k for k, a in enumerate(atoms) if a.start), key=lambda k: -len(atoms[k].start))
        while todo:
            n = max(1, _CELLS // len(atoms[todo[0]].start))
            some, todo = todo[:n], todo[n:]
            for k, spans in zip(some, self._join([atoms[k] for k in some], len(patterns) + 1, chunk_size, smallest, overlap), strict=True):
                out[k] = _chunks(texts[k], spans)
        return out

    @staticmethod
    def _join(texts: list[_Atoms], deepest: int, largest: int, smallest: int, overlap: int) -> list[list[tuple[int, int]]]:
        """Spans of the cheapest chunks of each text, longest text first. Step i finds the cheapest plan that ends with atom i - 1, in all texts; arrays have a row an atom, a column a text."""
        count = np.array([len(t.start) for t in texts])
        n, kinds = int(count[0]), deepest + 1

        def filled(values: list[array]) -> np.ndarray:
            out = np.zeros((len(texts), n + 1), np.int64)
            out[np.arange(n + 1) < count[:, None]] = np.concatenate(values)
            return np.ascontiguousarray(out.T)

        first, last, fine, cut, lines, inner = (filled([getattr(t, name) for t in texts]) for name in ("first", "last", "depth", "cut", "lines", "inner"))
        cut[0], lines[0] = 0, 2  # at the start of atom i, and after the last
        ends = (count, np.arange(len(texts)))
        cut[ends], lines[ends] = 0, 2
        width = 3 * kinds
        # the cost of an edge, by its cut and line, then what the chunk hides
        price = np.array([_steps(c, f) + _LINE * max(0, hidden - own) for c in range(kinds) for own in range(3) for f in range(kinds) for hidden in range(3)], np.int64)
        edge = (3 * cut + lines) * width
        least, most = np.zeros_like(fine), np.zeros_like(fine)  # of the cuts and lines that a chunk from here would hide
        cost, before = np.zeros_like(first), np.zeros_like(first)  # of the plan that ends before an atom, and the first atom of its last chunk
        joined, link = np.zeros_like(first), np.zeros_like(first)  # the cheapest plan before a chunk from here, and where it ends
        chosen = np.zeros_like(first)
        lo = near = 0
        columns = np.arange(len(texts))
        active = np.searchsorted(-count, -np.arange(1, n + 1), "right")
        for i in range(1, n + 1):
            k, j = int(active[i - 1]), i - 1
            while lo < j and (last[j, :k] - first[lo, :k] > largest).all():
                lo += 1
            np.minimum(least[lo:j, :k], cut[j, :k], out=least[lo:j, :k])
            np.maximum(most[lo:j, :k], np.maximum(lines[j, :k], inner[j, :k]), out=most[lo:j, :k])
            least[j, :k], most[j, :k] = deepest, inner[j, :k]
            if j:
                joined[j, :k], link[j, :k] = cost[j, :k] + (_UNIT if overlap else _UNIT // 2), j
            if overlap and j > 1:  # the plan before may reach into a chunk by `overlap` bytes
                near = max(near, 1)
                while near < j and (last[j - 1, :k] - first[near, :k] > overlap).all():
                    near += 1
                if near < j:
                    shared = last[j - 1, :k] - first[near:j, :k]
                    total = cost[j, :k] + _UNIT - shared * _UNIT // overlap
                    better = (shared <= overlap) & (before[j, :k] < np.arange(near, j)[:, None]) & (total < joined[near:j, :k])
                    joined[near:j, :k] = np.where(better, total, joined[near:j, :k])
                    link[near:j, :k][better] = j
            hides = np.minimum(least[lo:i, :k], fine[j, :k]) * 3 + most[lo:i, :k]
            size = last[j, :k] - first[lo:i, :k]
            total = price[edge[lo:i, :k] + hides] + price[edge[i, :k] + hides] + joined[lo:i, :k] + (size < smallest) * _SMALL
            total[:-1][size[:-1] > largest] = 1 << 60
            at = j - total[::-1].argmin(axis=0)  # the shortest of the cheapest
            here = columns[:k]
            cost[i, :k], before[i, :k], chosen[i, :k] = total[at - lo, here], at, link[at, here]
        out = []
        for c, t in enumerate(texts):
            spans, i, froms, links = [], len(t.start), before[:, c].tolist(), chosen[:, c].tolist()
            while i:
                spans.append((t.start[froms[i]], t.end[i - 1]))
                i = links[i]
            out.append(spans[::-1])
        return out


def _chunk_type() -> pa.StructType:
    position = pa.struct([(n, pa.int64()) for n in ("byte_offset", "char_offset", "line", "column")])
    return pa.struct([("text", pa.string()), ("start", position), ("end", position)])


def _by_size(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of _AT_ONCE bytes of text at most, or one row."""
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False))))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + _AT_ONCE, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _split(splitter, texts: list[str], options: dict) -> list[list[dict]]:
    if hasattr(splitter, "split_all"):
        return splitter.split_all(texts, **options)
    return [splitter.split(t, **options) if t else [] for t in texts]


def _dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the shuffle's partitions: a file of few row groups would keep few cores busy."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_column(df: DataFrame, key: str, text: str, splitter, **options) -> DataFrame:
    """(key, ordinal, text, start, end) of every chunk of every row, by a splitter's split(); null texts have none."""
    own = _dealt(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ordinal", pa.int64()), *_chunk_type()])
        for whole in batches:
            for batch in _by_size(whole, "text"):
                rows, owners = [], []
                for i, chunks in enumerate(_split(splitter, [t or "" for t in batch["text"].to_pylist()], options)):
                    for k, c in enumerate(chunks):
                        rows.append(c | {"ordinal": k})
                        owners.append(i)
                made = pa.Table.from_pylist(rows, schema).combine_chunks()
                for part in made.to_batches():
                    yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(owners, pa.int64())), *part.columns], ["key", *schema.names])

    out = own.mapInArrow(cut, f"key {own.schema['key'].dataType.simpleString()}, ordinal bigint, text string, start {POSITION}, end {POSITION}")
    return out.withColumnRenamed("key", key)


def split_rows(df: DataFrame, text: str, splitter, into: str = "chunks", **options) -> DataFrame:
    """df with the chunks of each row's text as an array; those without text have an empty one. No row is joined again with its text."""
    own = _dealt(df)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pa.list_(_chunk_type())
        for whole in batches:
            for batch in _by_size(whole, text):
                chunks = _split(splitter, [t or "" for t in batch[text].to_pylist()], options)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, made)], [*batch.schema.names, into])

    return own.mapInArrow(cut, StructType([*own.schema.fields, *StructType.fromDDL(f"{into} {CHUNK}")]))


#: Classes of Java's expressions: what Python takes for white space, and what the default separators drop.
BLANKS = r"\s\x1c-\x1f\x85\p{Z}"
DROPPED = BLANKS + r".?!。？！;:\-—；：,，"


def covered(text: Column, chunks: Column) -> Column:
    """(gap, inside) structs of a text and its chunks without overlap: what is left out before each chunk and after the last, and whether the chunk stands where it says.

    Pieces are cut by byte, since to find a character a text is walked through from its start.
    """

    def pieces(whole: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            return F.substring(whole, (a + 1).cast("int"), (b - a).cast("int")).cast("string")

        def after(last: Column, unit: str) -> Column:
            return F.coalesce(last["end"][unit], F.lit(0))

        def piece(c: Column, i: Column) -> Column:
            last, start, end = F.get(chunks, i - 1), c["start"], c["end"]
            gap, size = cut(after(last, "byte_offset"), start["byte_offset"]), F.length(c["text"])
            inside = (cut(start["byte_offset"], end["byte_offset"]) == c["text"]) & (F.length(gap) == start["char_offset"] - after(last, "char_offset")) & (size == end["char_offset"] - start["char_offset"])
            return F.struct(gap.alias("gap"), inside.alias("inside"))

        rest = cut(after(F.try_element_at(chunks, F.lit(-1)), "byte_offset"), F.octet_length(whole))
        return F.concat(F.transform(chunks, piece), F.array(F.struct(rest.alias("gap"), F.lit(True).alias("inside"))))

    return let(text.cast("binary"), pieces)


def split_lines(df: DataFrame, key: str, text: str, separator: str = "\n") -> DataFrame:
    """(key, start, text): pieces between plain separators, trimmed, none empty, with the character offset of each. No Python."""
    raw = df.select(key, F.col(text).alias("__t"), F.split(F.col(text), F.lit(re.escape(separator)), -1).alias("__p"))
    ends = F.aggregate("__p", F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p) + len(separator)))
    each = raw.select(key, F.posexplode(F.arrays_zip(F.col("__p").alias("p"), F.slice(ends, 1, F.size("__p")).alias("at"))))
    lead = F.length("col.p") - F.length(F.regexp_replace("col.p", r"^[ \t\n\r\x0b\f]+", ""))
    body = F.regexp_replace(F.regexp_replace("col.p", r"^[ \t\n\r\x0b\f]+", ""), r"[ \t\n\r\x0b\f]+$", "")
    return each.select(key, (F.col("col.at") + lead).cast("bigint").alias("start"), body.alias("text")).where("text <> ''")


def ascii_words(text: Column, shortest: int = 2) -> Column:
    """Runs of ASCII letters and digits in lower case, of `shortest` characters at least."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= shortest)


def let(value: Column, body) -> Column:
    """body(value), the value computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counted(items: Column) -> Column:
    """Distinct items of an array with their numbers, as (n, item) structs in the order of the items."""

    def runs(ordered: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == F.size(ordered)) | (F.element_at(ordered, i) != F.get(ordered, i)))
        return let(last, lambda ends: F.transform(ends, lambda e, i: F.struct((e - F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))).alias("n"), F.element_at(ordered, e).alias("item"))))

    return F.when(F.size(items) > 0, let(F.array_sort(items), runs)).otherwise(F.array().cast("array<struct<n:int,item:string>>"))


def top_tokens(df: DataFrame, key: str, text: str, n: int = 6) -> DataFrame:
    """(key, token, n, rank): the most frequent tokens of each row, ties by token. Counted within the row: no shuffle; a key that repeats is counted row by row."""
    best = F.slice(F.array_sort(F.transform(counted(ascii_words(F.col(text))), lambda c: F.struct((-c["n"]).alias("less"), c["item"].alias("token")))), 1, n)
    each = df.select(key, F.posexplode(best).alias("at", "best"))
    return each.select(key, F.col("best.token").alias("token"), (-F.col("best.less")).cast("bigint").alias("n"), (F.col("at") + 1).alias("rank"))


def sections(text: Column) -> Column:
    """Pieces of a text, each from one heading (# at the start of a line) to the next."""
    return F.filter(F.split(text, r"(?m)(?=^#{1,6} )"), lambda s: F.trim(s) != "")


def shingles(tokens: Column, span: int) -> Column:
    """Runs of `span` tokens that overlap, joined by spaces; none of a shorter list. The tokens are computed once a row, not once a run."""

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - span + 1)
        return F.when(F.size(words) >= span, F.transform(starts, lambda i: F.array_join(F.slice(words, i, span), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\u0000", "")


def decode_bom(content: Column) -> Column:
    """Text of bytes by their byte order mark, else as UTF-8 with replacement."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head.startswith("EFBBBF"), F.decode(F.substring(content, 4, 1 << 30), "UTF-8"))
        .when(head.isin("FFFE0000", "0000FEFF"), F.decode(content, "UTF-32"))
        .when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16"))
        .otherwise(F.decode(F.encode(content.cast("string"), "UTF-8"), "UTF-8"))
    )


#: Languages and the extensions of their files: fixed values.
LANGUAGES = {
    "ada": "adb ads", "agda": "agda", "asm": "asm nasm s", "astro": "astro", "bash": "bash sh", "beancount": "beancount", "bicep": "bicep", "c": "c",
    "cairo": "cairo", "capnp": "capnp", "clojure": "clj cljc cljs", "cmake": "cmake", "cpp": "cc cpp cxx h hh hpp hxx", "csharp": "cs csx",
    "css": "css scss", "csv": "csv", "cuda": "cuda", "dart": "dart", "dockerfile": "dockerfile", "elisp": "el", "elixir": "ex exs", "elm": "elm",
    "erlang": "erl hrl", "fish": "fish", "fortran": "f f03 f90 f95", "fsharp": "fs fsi fsx", "func": "func", "gdscript": "gd",
    "gitignore": "gitignore", "gleam": "gleam", "glsl": "glsl", "gn": "gn", "go": "go", "graphql": "gql graphql", "groovy": "gradle groovy",
    "hack": "hack", "haskell": "hs", "hcl": "hcl tf", "heex": "heex", "hlsl": "hlsl", "html": "htm html xhtml", "ini": "cfg ini", "janet": "janet",
    "java": "java", "javascript": "cjs js jsx mjs", "json": "geojson json jsonl", "jsonnet": "jsonnet", "julia": "jl", "kotlin": "kt kts",
    "lua": "lua", "markdown": "md mdx", "matlab": "m", "nix": "nix", "ocaml": "ml mli", "pascal": "pascal", "perl": "perl pl pm", "php": "php",
    "proto": "proto", "python": "py pyi pyw", "r": "r", "ruby": "rb", "rust": "rs", "scala": "scala", "solidity": "sol", "sql": "sql",
    "svelte": "svelte", "swift": "swift", "tcl": "tcl", "thrift": "thrift", "toml": "toml", "tsx": "tsx", "typescript": "cts mts ts", "verilog": "v",
    "vhdl": "vhd vhdl", "vue": "vue", "xml": "xml", "yaml": "yaml yml", "zig": "zig",
}


def language_table(extra: dict[str, str] | None = None) -> dict[str, str]:
    """Extension in lower case -> language; `extra` adds or replaces entries."""
    out = {e: name for name, es in LANGUAGES.items() for e in es.split()}
    return out | {e.lower().lstrip("."): name for e, name in (extra or {}).items()}


def detect_language(filename: Column, extra: dict[str, str] | None = None) -> Column:
    """Programming language of a file name by its extension, null if unknown."""
    table = F.create_map(*[F.lit(x) for kv in language_table(extra).items() for x in kv])
    extension = F.nullif(F.regexp_extract(F.lower(filename), r"\.([^./]+)$", 1), F.lit(""))
    return F.try_element_at(table, extension)
