"""Benchmark passages in training texts, by spaced seeds (operator 10).

A mask names the word positions of a window that count; the others may differ. Words of
test items and training texts are hashed under every mask, equal hashes are joined, and the
hits of a document and an item are grouped by diagonal (how far one is shifted against the
other). Each diagonal is verified once, over its whole length: the run of greatest score,
where a substitution costs more than a match earns, and if that one is no overlap, the run
of most agreeing words that is one.

The test side is dealt into blocks of whole items. Each block is sent to the executors,
which join it with all texts, so neither side is shuffled and a test set of any size is
held whole, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm import textkit
from freshet.llm.runtime import table

#: Positions that count: fixed values.
MASKS = ("1110100111", "1101011011", "11001110101", "1011110011")
BLOCK_WORDS = 400_000  # of test items held at once (a longer item is a block of its own)
PAIRS = 1 << 18  # hits listed one by one; where equal seeds make more, their diagonals come from a convolution
_FILTER_BITS = 24
PART_BYTES = 3 << 20  # of text, hashed at once
_MULT = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(max(map(len, MASKS)))], np.uint64)
_PENALTY = 2.0


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window's counting words, for every start that leaves room."""
    m = max(0, len(words) - len(mask) + 1)
    out = np.zeros(m, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out += words[k : k + m] * _MULT[k]
    return textkit.mix(out ^ np.uint64(MASKS.index(mask) + 1))


def best_run(same: np.ndarray) -> tuple[int, int]:
    """The run (begin, end) of greatest score, 1 a match, -2 a substitution; the first of equals, the longest from its begin."""
    total = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -_PENALTY))))
    low = np.minimum.accumulate(total)
    gain = total - low
    end = int(np.argmax(gain))
    return int(np.argmax(total[: end + 1] == low[end])), end


def longest_run(same: np.ndarray, min_words: int, identity: float) -> tuple[int, int] | None:
    """The run (begin, end) of most matches among all that have `min_words` and the share `identity` of them; the first of equals, none if there is none."""
    many = np.concatenate(([0], np.cumsum(same)))
    if many[-1] < min_words:
        return None
    over = np.round(many - identity * np.arange(len(many)), 9)  # a run has its share if this does not fall from begin to end
    begins = np.searchsorted(-np.minimum.accumulate(over), -over, "left")
    end = int(np.argmax(many - many[begins]))
    begin = int(begins[end])
    if many[end] - many[begin] < min_words:
        return None
    return begin + int(np.argmax(same[begin:end])), end


def best_overlap(same: np.ndarray, min_words: int, identity: float) -> tuple[int, int] | None:
    """The run (begin, end) that a diagonal counts with: best_run if it is an overlap, else longest_run."""
    x, y = best_run(same)
    matched = int(same[x:y].sum())
    return (x, y) if matched >= min_words and matched >= identity * (y - x) else longest_run(same, min_words, identity)


def shifts(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """All distinct differences of a position of `mine` and one of `theirs`, in time far below their product where that is great."""
    if len(mine) * len(theirs) <= PAIRS:
        return np.unique(mine[:, None] - theirs[None, :])
    low, high = int(mine.min()), int(theirs.max())
    a, b = mine - low, high - theirs
    size = 1 << int(a.max() + b.max() + 1).bit_length()
    x, y = np.zeros(size, np.float32), np.zeros(size, np.float32)
    x[a], y[b] = 1, 1
    return np.flatnonzero(np.fft.irfft(np.fft.rfft(x) * np.fft.rfft(y), size) > 0.5) + low - high


class TestBlock:
    """Seeds of some test items, sorted, with a filter in front."""

    __test__ = False

    def __init__(self, items: list, words: list[np.ndarray]):
        self.items = items
        self.bound = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *words])
        self.index = []
        for mask in MASKS:
            at = [np.arange(max(0, len(w) - len(mask) + 1)) + b for w, b in zip(words, self.bound, strict=False)]
            h = np.concatenate([np.zeros(0, np.uint64), *(seeds(w, mask) for w in words)])
            at = np.concatenate([np.zeros(0, np.int64), *at]).astype(np.int64)
            order = np.argsort(h, kind="stable")
            gate = np.zeros(1 << _FILTER_BITS, bool)
            gate[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            self.index.append((h[order], at[order], np.packbits(gate)))

    def _hits(self, words: np.ndarray, bound: np.ndarray) -> dict[tuple[int, int], list[np.ndarray]]:
        """By document and item, the diagonals on which a seed of both is equal (each with repetitions)."""
        out: dict[tuple[int, int], list[np.ndarray]] = {}
        for mask, (h, at, gate) in zip(MASKS, self.index, strict=True):
            mine = seeds(words, mask)
            slot = (mine >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
            spots = np.flatnonzero((gate[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1)
            docs = np.searchsorted(bound, spots, "right") - 1
            inside = spots + len(mask) <= bound[docs + 1]
            spots, docs = spots[inside], docs[inside]
            lo = np.searchsorted(h, mine[spots], "left")
            hit = lo < len(h)
            hit[hit] = h[lo[hit]] == mine[spots[hit]]
            spots, docs, lo = spots[hit], docs[hit], lo[hit]
            # equal seeds of one document stand together: group by (document, seed)
            order = np.lexsort((spots, lo, docs))
            spots, docs, lo = spots[order], docs[order], lo[order]
            cuts = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (lo[1:] != lo[:-1])))) if len(spots) else np.zeros(0, np.int64)
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(spots)], strict=True) if len(cuts) else ():
                d, first = int(docs[i]), int(lo[i])
                places = at[first : int(np.searchsorted(h, h[first], "right"))]
                owner = np.searchsorted(self.bound, places, "right") - 1
                for w in np.unique(owner).tolist():
                    own = places[owner == w] - self.bound[w]
                    out.setdefault((d, w), []).append(shifts(spots[i:j] - bound[d], own))
        return out

    def overlaps(self, words: np.ndarray, bound: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int, int, int, int]]:
        """The overlap of most agreeing words of each document and item that have one: (document, item, agreeing words, words of the run, first word in the document, in the item).

        Diagonals are verified from the one with most room to that with least, until none has room for more words than were found.
        """
        out = []
        for (d, w), each in sorted(self._hits(words, bound).items()):
            mine, theirs = words[bound[d] : bound[d + 1]], self.words[self.bound[w] : self.bound[w + 1]]
            shift = np.unique(np.concatenate(each))
            room = np.minimum(shift + len(theirs), len(mine)) - np.maximum(shift, 0)
            best: tuple[int, int, int, int] | None = None
            for k in np.lexsort((np.maximum(-shift, 0), np.maximum(shift, 0), -room)).tolist():
                s, size = int(shift[k]), int(room[k])
                if size < min_words or (best and (size < best[0] or (size == best[0] == -best[1]))):
                    break
                a, b = max(s, 0), max(-s, 0)
                same = mine[a : a + size] == theirs[b : b + size]
                if np.count_nonzero(same) < max(min_words, best[0] if best else 0):
                    continue
                run = best_overlap(same, min_words, identity)
                if run is None:
                    continue
                x, y = run
                mark = (int(same[x:y].sum()), x - y, -(a + x), -(b + x))
                best = mark if best is None else max(best, mark)
            if best:
                out.append((d, w, best[0], -best[1], -best[2], -best[3]))
        return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in textkit.by_bytes(whole, PART_BYTES):
            words, bound = textkit.word_hashes(batch.column(1))
            parts = pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), parts], ["item", "words"])


def test_blocks(tests: DataFrame, item_col: str = "item_id", text_col: str = "text", min_words: int = 12) -> Iterator[TestBlock]:
    """The test items, whole, in blocks of about BLOCK_WORDS words; items of fewer than `min_words` words tell nothing and are left out."""
    own = tests.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    hashed = own.mapInArrow(textkit.tidy(_hashed), f"item {own.schema['item'].dataType.simpleString()}, words array<long>").where(F.size("words") >= min_words)
    total = int(hashed.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0])
    blocks = -(-total // BLOCK_WORDS)
    if blocks > 1:
        hashed = table(hashed, "test-items")
    for b in range(blocks):
        rows = hashed.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b).orderBy("item", "words").toArrow()
        yield TestBlock(rows["item"].to_pylist(), [w.values.to_numpy().view(np.uint64) for w in rows["words"]])


test_blocks.__test__ = False


def _finder(block, min_words: int, identity: float, kind: pa.DataType):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestBlock = block.value
        for whole in batches:
            for batch in textkit.by_bytes(whole, PART_BYTES):
                words, bound = textkit.word_hashes(batch.column(1))
                found = tests.overlaps(words, bound, min_words, identity)
                rows = np.array(found, np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[:, 0])), pa.array([tests.items[w] for w in rows[:, 1]], kind), pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(rows[:, 4]), pa.array(rows[:, 5])],
                    ["id", "item", "matched", "run", "doc_at", "item_at"],
                )

    return find


def find_overlaps(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_words: int = 12, identity: float = 0.75) -> DataFrame:
    """(id, item, matched_words, run_words, doc_word, item_word): the longest overlap of each document and test item that have one.

    An overlap is a run of aligned words of which at least `min_words` agree and at least the
    share `identity`; words are compared in lower case without punctuation. Of equally many
    agreeing words the shorter run counts, then the first in the document, then in the item.
    Null and empty texts, and those without a seed in common, have none. Items that share an
    id are reported together. Rows that share an id (null too) are reported together; other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type, item_type = own.schema["id"].dataType.simpleString(), tests.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, matched long, run long, doc_at long, item_at long"
    out = spark.createDataFrame([], schema)
    for block in test_blocks(tests, item_col, text_col, min_words):
        kind = pa.array(block.items[:1]).type if item_type not in ("int", "bigint", "string") else {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[item_type]
        out = out.unionByName(own.mapInArrow(textkit.tidy(_finder(spark.sparkContext.broadcast(block), min_words, identity, kind)), schema))
    best = out.groupBy("id", "item").agg(F.max(F.struct("matched", (-F.col("run")).alias("run"), (-F.col("doc_at")).alias("doc_at"), (-F.col("item_at")).alias("item_at"))).alias("best"))
    return best.select(
        F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.matched").alias("matched_words"), (-F.col("best.run")).alias("run_words"), (-F.col("best.doc_at")).alias("doc_word"), (-F.col("best.item_at")).alias("item_word")
    )


def _keeper(block, column: str, min_words: int, identity: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: TestBlock = block.value
        for whole in batches:
            at = whole.schema.get_field_index(column)
            for batch in textkit.by_bytes(whole, PART_BYTES, at):
                words, bound = textkit.word_hashes(batch.column(at))
                clean = np.ones(len(batch), bool)
                clean[[o[0] for o in tests.overlaps(words, bound, min_words, identity)]] = False
                yield batch.filter(pa.array(clean))

    return keep


def decontaminate(docs: DataFrame, tests: DataFrame, text_col: str = "text", item_col: str = "item_id", min_words: int = 12, identity: float = 0.75) -> DataFrame:
    """`docs`, all columns, without the rows whose text overlaps a test item (see find_overlaps). No shuffle.

    Column names of `docs` must differ from each other.
    """
    for block in test_blocks(tests, item_col, "text", min_words):
        docs = docs.mapInArrow(textkit.tidy(_keeper(docs.sparkSession.sparkContext.broadcast(block), text_col, min_words, identity)), docs.schema)
    return docs
