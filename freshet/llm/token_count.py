"""Counts of subword tokens, by merging symbol arrays in step of rank (operator 9).

Texts are cut at white space and before punctuation that ends a piece, which no token of
this vocabulary crosses. The distinct pieces of a batch that no earlier batch has seen go through the vocabulary's own normaliser
and pre-tokeniser, as the `tokenizers` library has them; their distinct pre-tokens are held
together as one ragged array of symbol ids. In each round every pre-token merges its own
lowest-ranked pair, all pre-tokens at once; what is left when nothing can merge is counted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.textkit import Memory, by_bytes, tidy

BATCH_SYMBOLS = 1 << 20
KNOWN_WORDS = 100_000  # pieces, and pre-tokens, remembered between batches, or up to twice as many
PART_BYTES = 3 << 20  # of text, counted at once
_NONE = np.int64(1 << 60)
_SPACE = re.compile(r"\s")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Merge rules of a byte-pair vocabulary file, behind the library's normaliser and pre-tokeniser."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)
        self._normal, self._pre = tool.normalizer, tool.pre_tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if not cuts_at_space(spec):
            raise ValueError("the vocabulary normalises or splits texts in another way")
        model = spec["model"]
        vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, special))) if special else None
        suffix = model["end_of_word_suffix"] or ""
        self._inner, self._last = np.zeros(512, np.int64), np.zeros(512, np.int64)  # by the character that stands for a byte
        for c in byte_symbols():
            self._inner[ord(c)], self._last[ord(c)] = vocab[c], vocab[c + suffix]
        self._size = len(vocab) + 1
        pairs = np.array([[vocab[a], vocab[b]] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = pairs[:, 0] * self._size + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self._keys, self._rank, self._made = keys[order], order.astype(np.int64), made
        first = np.full(self._size, -1, np.int64)
        for rank, m in enumerate(made):
            if first[m] >= 0:
                raise ValueError("two merges make one symbol: merging all places of a pair at once would not be exact")
            first[m] = rank
        if (np.maximum(first[pairs[:, 0]], first[pairs[:, 1]]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge comes before the one that makes its part")
        self._words, self._pieces = Memory(KNOWN_WORDS), Memory(KNOWN_WORDS)

    def forget(self) -> None:
        """Drops what was remembered: the worker may go on to other work."""
        self._words.forget()
        self._pieces.forget()

    def pre_tokens(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Pre-tokens of texts, none of which has a special string, and whose they are; a character stands for each byte."""
        plain = [i for i, t in enumerate(texts) if t and not _SPACE.search(t)]
        joined = self._normal.normalize_str(" ".join([texts[i] for i in plain]))
        gaps = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 32)
        if len(gaps) != max(0, len(plain) - 1):  # white space of another kind: each text by itself
            plain, joined, gaps = [], "", gaps[:0]
        words, owner = [], np.zeros(0, np.int64)
        if plain:
            found = self._pre.pre_tokenize_str(joined)
            words = [w for w, _ in found]
            starts = np.fromiter((at for _, (at, _) in found), np.int64, len(found))
            owner = np.array(plain, np.int64)[np.searchsorted(gaps, starts)]
        for i in sorted({i for i, t in enumerate(texts) if t} - set(plain)):
            own = [w for w, _ in self._pre.pre_tokenize_str(self._normal.normalize_str(texts[i]))]
            words += own
            owner = np.append(owner, np.full(len(own), i))
        return words, owner

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = 0
        while at < len(words):
            to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_SYMBOLS, "right")) + at)
            out[at:to] = self._merge(np.frombuffer("".join(words[at:to]).encode("utf-32-le"), np.uint32), sizes[at:to])
            at = to
        return out

    def _merge(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ids = self._inner[raw]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self._last[raw[ends]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        done = np.zeros(len(sizes), np.int64)
        while len(ids) > 1:
            key = ids[:-1] * self._size + ids[1:]
            found = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            rank = np.where((self._keys[found] == key) & (owner[:-1] == owner[1:]), self._rank[found], _NONE)
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(rank, starts)
            alive = least < _NONE
            done[owner[starts[~alive]]] = size[~alive]
            if not alive.all():
                keep = np.repeat(alive, size)
                ids, owner, rank = ids[keep], owner[keep], rank[keep]
                size, least = size[alive], least[alive]
                if not len(ids):
                    return done
            here = rank == np.repeat(least, size)
            if (here[1:] & here[:-1]).any():  # aaa: from the left, every other one of a run
                spot = np.flatnonzero(here)
                run = np.cumsum(np.concatenate(([0], np.diff(spot) > 1)))
                begin = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
                here[spot[(np.arange(len(spot)) - begin[run]) % 2 == 1]] = False
            ids = ids.copy()
            ids[here] = self._made[rank[here]]
            stay = np.ones(len(ids), bool)
            stay[1:][here[:-1]] = False
            ids, owner = ids[stay], owner[stay]
        if len(ids):
            done[owner[0]] = 1
        return done

    def word_counts(self, words: list[str]) -> np.ndarray:
        """Tokens of distinct pre-tokens, most of which earlier batches have seen."""
        return np.array(self._words.values(words, lambda fresh: self.counts(fresh).tolist()), np.int64)

    def piece_counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each text; special strings in it are one each."""
        return np.array(self._pieces.values(pieces, lambda fresh: self._fresh_counts(fresh).tolist()), np.int64)

    def _fresh_counts(self, parts: list[str]) -> np.ndarray:
        many, owner = len(parts), np.arange(len(parts))
        total = np.zeros(many, np.int64)
        if self._special and self._special.search(" ".join(parts)):
            cut = [self._special.split(p) for p in parts]
            total += np.fromiter(map(len, cut), np.int64, len(cut)) - 1
            parts, owner = [x for c in cut for x in c], np.repeat(owner, total + 1)
        words, of = self.pre_tokens(parts)
        if words:
            coded = pa.array(words, pa.string()).dictionary_encode()
            each = self.word_counts(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            total += np.bincount(owner[of], each, many).astype(np.int64)
        return total


def ragged_take(values: np.ndarray, bound: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a ragged array (values, n + 1 bounds), and the bounds of the result."""
    size = np.diff(bound)[rows]
    out = np.concatenate(([0], np.cumsum(size)))
    return values[np.repeat(bound[:-1][rows] - out[:-1], size) + np.arange(out[-1])], out


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


#: What this cutting is exact for: the pre-token pattern and the normalisers of the vocabulary, fixed values.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = ["NFC", "Replace", "Lowercase"]
#: A run of punctuation between a letter or digit and white space is a pre-token by itself in every version of Unicode.
_TAIL = "([0-9A-Za-zÀ-ÖØ-öø-ÿ])([!\"#$%&()*+,\\-./:;=?@\\[\\]^_`{}~]+)( |$)"


def cuts_at_space(spec: dict) -> bool:
    """Whether a vocabulary gives the same ids for a text and for what pieces_of makes of it."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    return steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and steps[0].get("pattern") == {"Regex": SPLIT} and kinds == NORMAL


def pieces_of(texts: pa.Array, tails: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces between ASCII white space (the empty one too), punctuation at their ends apart if `tails`, which piece stands where, and the documents' bounds in that."""
    data = texts.buffers()[2]
    raw = memoryview(data).tobytes() if data is not None else b""
    for space in (b"\n", b"\t", b"\r"):
        if space in raw:
            texts = pc.replace_substring(texts, space.decode(), " ")
    if tails:
        texts = pc.replace_substring_regex(texts, _TAIL, "\\1 \\2\\3")
    pieces = pc.split_pattern(texts, " ")
    flat = pieces.flatten().dictionary_encode()
    offsets = pieces.offsets.to_numpy()
    return flat.dictionary, flat.indices.to_numpy(), offsets - offsets[0]


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(path)
        tool.forget()
        for whole in batches:
            for batch in by_bytes(whole, PART_BYTES):
                texts = pc.fill_null(batch.column(1), "")
                pieces, at, bound = pieces_of(texts)
                total = np.concatenate(([0], np.cumsum(tool.piece_counts(pieces.to_pylist())[at]))) if len(at) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(total[bound[1:]] - total[bound[:-1]])], ["id", "n_bytes", "n_tokens"]
                )
        tool.forget()

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of `docs`, in no order.

    The counts are those of the `tokenizers` library for the vocabulary file at `path`,
    without added begin or end tokens; special strings in a text count as one token, as
    that library has it by default. A null text counts as empty: 0 bytes, 0 tokens. Ids may
    repeat or be null; other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = own.mapInArrow(tidy(_counter(path)), f"id {own.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
