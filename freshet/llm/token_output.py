"""Token ids in seekable binary files (operator 6).

One file per range of ids, documents in ascending order of id. A document is one zstandard
frame: its ids as little-endian unsigned integers of 2 bytes, or of 4 where the vocabulary
has more than 65,536 entries. After the frames comes a seek table, itself in a skippable
zstandard frame, so that any zstandard tool can read the whole file:

    5E 2A 4D 18, length of what follows (u32)
    for each document: compressed size, decompressed size, checksum (u32 each)
    number of documents (u32), bytes of an id (u8), B1 EA 92 8F

The checksum is the CRC-32 of the decompressed bytes. A reader takes the last 9 bytes, then
the table, then only the frames of the documents that it wants.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.runtime import new_folder, open_fs, partitions, table
from freshet.llm.textkit import Memory, by_bytes, tidy
from freshet.llm.token_count import cuts_at_space, pieces_of, ragged_take

_SKIP, _END = b"\x5e\x2a\x4d\x18", b"\xb1\xea\x92\x8f"
_INDEX = "id long, file string, frame_at long, frame_bytes long, frame long, n_tokens long, before long, part int"
KNOWN_WORDS = 150_000  # remembered between batches, or up to twice as many
AT_ONCE = 8_192  # pieces encoded in one call
PART_BYTES = 4 << 20  # of text, encoded at once


#: A character that makes a piece odd: not among printable ASCII and the Latin letters up to U+00FF, which all versions of Unicode treat alike.
_ODD = "[^!-~À-ÖØ-öø-ÿ]"
#: The vocabulary's pre-token pattern for lower-case text without odd characters, and the gap between two pieces.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+| ")


class Encoder:
    """Ids of texts by the tokenizers library.

    A vocabulary that drops white space gives the same ids for a text and for its pieces
    (see cuts_at_space): then the library sees each distinct word of plain pieces once, and
    odd pieces and those with special strings whole, with the unchanged tokenizer. With
    other vocabularies it sees whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tool = Tokenizer.from_file(path)
        self.width = 2 if self._tool.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._by_piece = cuts_at_space(spec)
        if self._by_piece:  # for a word that is a pre-token in normal form already
            plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
            self._word_tool = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": plain}))
            self._odd = "|".join([_ODD, *(re.escape(t["content"]) for t in spec["added_tokens"])])
        self._words, self._odd_pieces = Memory(KNOWN_WORDS), Memory(KNOWN_WORDS // 2)

    def forget(self) -> None:
        """Drops what was remembered: the worker may go on to other work."""
        self._words.forget()
        self._odd_pieces.forget()

    def _encode(self, tool, texts: list[str]) -> list[bytes]:
        if len(texts) > AT_ONCE:  # few of the library's own objects at a time
            return [ids for lo in range(0, len(texts), AT_ONCE) for ids in self._encode(tool, texts[lo : lo + AT_ONCE])]
        each = [e.ids for e in tool.encode_batch_fast(texts, add_special_tokens=False)]
        bound = [0, *accumulate(map(len, each))]
        raw = np.fromiter(chain.from_iterable(each), np.uint32, bound[-1]).tobytes()
        return [raw[4 * a : 4 * b] for a, b in pairwise(bound)]

    def _plain_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of plain characters, as a ragged array."""
        tokens = pa.array(_WORDS.findall(" ".join(pieces).lower()), pa.string()).dictionary_encode()
        words, at = tokens.dictionary.to_pylist(), tokens.indices.to_numpy()
        gap = words.index(" ") if " " in words else -1
        ids = self._words.values(words, lambda fresh: self._encode(self._word_tool, fresh))
        if gap >= 0:
            ids[gap] = b""
        values, out = ragged_take(*_ragged(ids), at)
        return values, np.concatenate(([0], out[np.append(np.flatnonzero(at == gap), len(at))])) if pieces else np.zeros(1, np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the documents' bounds in them."""
        if not self._by_piece:
            return _ragged(self._encode(self._tool, texts.to_pylist()))
        pieces, at, bound = pieces_of(texts, tails=False)
        odd = pc.match_substring_regex(pieces, self._odd).to_numpy(zero_copy_only=False)
        values, ends = self._plain_ids(pieces.filter(pa.array(~odd)).to_pylist())
        more, more_ends = _ragged(self._odd_pieces.values(pieces.filter(pa.array(odd)).to_pylist(), lambda fresh: self._encode(self._tool, fresh)))
        place = np.empty(len(pieces), np.int64)  # of each piece among the plain ones, then the odd ones
        place[~odd], place[odd] = np.arange(len(pieces) - odd.sum()), len(pieces) - odd.sum() + np.arange(odd.sum())
        values, out = ragged_take(np.concatenate((values, more)), np.concatenate((ends, ends[-1] + more_ends[1:])), place[at])
        return values, out[bound]


def _ragged(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One array of the ids of all, and n + 1 bounds."""
    return np.frombuffer(b"".join(ids), np.uint32), np.concatenate(([0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4))).astype(np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task
    return Encoder(path)


def _writer(folder: str, path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        tool, squeeze = encoder(path), zstandard.ZstdCompressor(level=1)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"  # a repeated task writes another file; the rows name the right one
        out, at, before, seek = None, 0, 0, []
        for whole in batches:
            for batch in by_bytes(whole, PART_BYTES):
                if out is None:
                    fs, root = open_fs(folder)
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                ids, bound = tool.ids(pc.fill_null(batch.column(1), ""))
                size = np.diff(bound) + 1
                full = np.full(len(ids) + len(batch), end_id, np.uint32)
                full[np.arange(len(ids)) + np.repeat(np.arange(len(batch)), size - 1)] = ids
                raw = full.astype("<u2" if tool.width == 2 else "<u4").tobytes()
                ends = np.cumsum(size) * tool.width
                rows, begin, start = [], 0, len(seek)
                for end in ends.tolist():
                    piece = raw[begin:end]
                    frame = squeeze.compress(piece)
                    out.write(frame)
                    seek.append((len(frame), len(piece), zlib.crc32(piece)))
                    rows.append((at, len(frame)))
                    at, begin = at + len(frame), end
                rows = np.array(rows, np.int64).reshape(-1, 2)
                n = len(batch)
                firsts = before + np.cumsum(size) - size
                before += int(size.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([name] * n), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(start + np.arange(n)), pa.array(size), pa.array(firsts), pa.array(np.full(n, part, np.int32))],
                    ["id", "file", "frame_at", "frame_bytes", "frame", "n_tokens", "before", "part"],
                )
        if out is not None:
            entries = b"".join(struct.pack("<III", *s) for s in seek) + struct.pack("<IB", len(seek), tool.width) + _END
            out.write(_SKIP + struct.pack("<I", len(entries)) + entries)
            out.close()
        tool.forget()

    return write


class Reader:
    """Documents of one file, by their number in it; reads and decompresses only those that are asked for."""

    def __init__(self, fs, path: str):
        self._file = fs.open_input_file(path)
        size = self._file.size()
        tail = self._file.read_at(9, size - 9)
        if tail[5:] != _END:
            raise ValueError("no seek table")
        count, self.width = struct.unpack("<IB", tail[:5])
        head = self._file.read_at(8, size - 17 - 12 * count)
        if head != _SKIP + struct.pack("<I", 12 * count + 9):
            raise ValueError("seek table does not fit the file")
        self.seek = np.frombuffer(self._file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(count, 3)
        self.at = np.concatenate(([0], np.cumsum(self.seek[:, 0], dtype=np.int64)))

    def run(self, first: int, last: int) -> list[np.ndarray]:
        """The ids of documents first to last - 1, read at once."""
        import zstandard

        squeezed = self._file.read_at(int(self.at[last] - self.at[first]), int(self.at[first]))
        tool, out = zstandard.ZstdDecompressor(), []
        for k in range(first, last):
            lo = int(self.at[k] - self.at[first])
            raw = tool.decompress(squeezed[lo : lo + int(self.seek[k, 0])], max_output_size=int(self.seek[k, 1]) or 1)
            if len(raw) != self.seek[k, 1] or zlib.crc32(raw) != self.seek[k, 2]:
                raise ValueError(f"document {k} is damaged")
            out.append(np.frombuffer(raw, "<u2" if self.width == 2 else "<u4"))
        return out

    def close(self) -> None:
        self._file.close()


def _checker(folder: str):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        name, reader = None, None
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                files, frames = batch.column(1).to_pylist(), batch.column(2).to_pylist()
                counts, sums, i = [], [], 0
                while i < len(files):
                    j = i + 1
                    while j < len(files) and files[j] == files[i] and frames[j] == frames[j - 1] + 1:
                        j += 1
                    if files[i] != name:
                        if reader:
                            reader.close()
                        name, reader = files[i], Reader(fs, f"{root}/{files[i]}")
                    for ids in reader.run(frames[i], frames[j - 1] + 1):
                        counts.append(len(ids))
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    i = j
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())], ["id", "part", "before", "n_tokens", "ids_crc32"])
        if reader:
            reader.close()

    return check


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Writes the files under `folder` and returns where each document is: id, file, frame (its number in the file), frame_at, frame_bytes, n_tokens, before (ids before it in the file), part.

    Null texts count as empty and have the end id alone. Rows with one id stand next to
    each other, ordered by a hash of their text; null ids come first. `order`, columns of
    `docs`, is another order to write in. Other columns are ignored, whatever their names.
    No row, no file.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[c.alias(f"order{i}") for i, c in enumerate(order or [])])
    # rows of one id are dealt by their text too: however many they are, no task has to take them all
    keys = [F.col(f"order{i}") for i in range(len(order))] if order else [F.col("id"), F.xxhash64("text")]
    ordered = own.repartitionByRange(files or partitions(spark), *keys).sortWithinPartitions(*keys).select("id", "text")
    return table(ordered.mapInArrow(tidy(_writer(folder, path, end_id)), _INDEX), "token-index")


def token_output(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, order: list[Column] | None = None) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from its bytes as read back from the files.

    start is the number of ids of all documents before it. See write_token_files for order,
    nulls and repeated ids.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    index = write_token_files(docs, folder, path, end_id, id_col, text_col, order=order)
    read = index.select("id", "file", "frame", "part", "before").mapInArrow(tidy(_checker(folder)), "id long, part int, before long, n_tokens long, ids_crc32 long")
    base = index.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))  # a row per file
    base = base.select("part", (F.sum("of_part").over(Window.orderBy("part")) - F.col("of_part")).alias("base"))
    return read.join(base, "part").select(F.col("id").alias(id_col), (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
