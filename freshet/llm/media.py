"""Media payloads in tar shards, addressed by content (operator 1).

A payload has one address, however many rows have it. Each task writes a tar shard with one
entry for each digest of its rows; of the entries that several tasks made for one digest the
index names one, and `compact` writes shards without the others. Payloads are never shuffled, only
digests and places are. Rows carry digest, shard, offset and length. Metadata comes from a
range read of the media header alone; a full read gives the payload back, as a check and
for features.

The form is an 8-bit greyscale PNG, 192 samples wide: lossless, and any image reader opens it.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.runtime import new_folder, open_fs, partitions, table

WIDTH = 192
HEADER_BYTES = 33  # signature and IHDR
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_BLOCK = 512


def pad(data: bytes, to: int = WIDTH) -> bytes:
    """Spaces appended up to a positive multiple."""
    return data + b" " * (-len(data) % to if data else to)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(samples: bytes, width: int = WIDTH, level: int = 6) -> bytes:
    """8-bit greyscale, rows unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    """Width, height, bit depth and colour type from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("no PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "depth": depth, "colour": colour}


def decode_png(data: bytes) -> bytes:
    """Samples of an 8-bit greyscale PNG, rows unfiltered, checksums verified."""
    head, at, packed = png_header(data[:HEADER_BYTES]), 8, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged PNG")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head["height"], head["width"] + 1)
    if rows[:, 0].any() or head["depth"] != 8 or head["colour"]:
        raise ValueError("another kind of PNG than this writes")
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Sixteen hexadecimal digits: which of 64 equal runs of the samples are lighter than the mean run."""
    values = np.frombuffer(samples, np.uint8)
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    cuts = np.arange(65) * len(values) // 64
    sums, sizes = np.diff(total[cuts]), np.diff(cuts)
    bits = sums * len(values) > total[-1] * sizes  # exact: no division
    return np.packbits(bits).tobytes().hex()


def _sharder(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"  # a repeated task writes another; rows name the right one
        seen: set[bytes] = set()  # digests of this task's rows
        out, at = None, 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                digests, offsets, lengths = [], [], []
                for text in whole.column(0).slice(lo, 500).to_pylist():
                    payload = pad((text or "").encode())
                    digest = hashlib.sha256(payload).digest()
                    if digest in seen:
                        continue
                    seen.add(digest)
                    media = encode_png(payload)
                    if out is None:
                        fs, root = open_fs(folder)
                        fs.create_dir(root, recursive=True)
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = tarfile.TarInfo(f"{digest.hex()[:2]}/{digest.hex()}.png")
                    info.size = len(media)
                    head, fill = info.tobuf(tarfile.USTAR_FORMAT), bytes(-len(media) % _BLOCK)
                    out.write(head + media + fill)
                    digests.append(digest.hex())
                    offsets.append(at + len(head))
                    lengths.append(len(media))
                    at += len(head) + len(media) + len(fill)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array([name] * len(digests), pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(2 * _BLOCK))
            out.close()

    return write


def write_media(texts: DataFrame, folder: str) -> DataFrame:
    """Writes the shards of a one-column table of texts; (digest, shard, offset, length), a row per distinct payload."""
    written = table(texts.mapInArrow(_sharder(folder), "digest string, shard string, offset long, length long"), "media-entries")
    index = written.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    return index.sortWithinPartitions("shard", "offset")  # so that a task reads each shard from front to back


def _open(cache: dict, fs, root: str, shard: str):
    if cache.get("name") != shard:
        if "file" in cache:
            cache["file"].close()
        cache["name"], cache["file"] = shard, fs.open_input_file(f"{root}/{shard}")
    return cache["file"]


def _head_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        cache: dict = {}
        for batch in batches:
            heads = [png_header(_open(cache, fs, root, r["shard"]).read_at(HEADER_BYTES, r["offset"])) for r in batch.select(["shard", "offset"]).to_pylist()]
            more = [pa.array([h[k] for h in heads], pa.int32()) for k in ("width", "height", "depth")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "width", "height", "depth"])

    return read


def read_headers(index: DataFrame, folder: str) -> DataFrame:
    """`index` with width, height and depth, from range reads of 33 bytes a payload."""
    return index.mapInArrow(_head_reader(folder), index.schema.simpleString()[7:-1].replace(",", ", ").replace(":", " ") + ", width int, height int, depth int")


def _payload_reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        cache: dict = {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
                for r in batch.select(["shard", "offset", "length"]).to_pylist():
                    media = _open(cache, fs, root, r["shard"]).read_at(r["length"], r["offset"])
                    payload = decode_png(media)
                    for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)), strict=True):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(v, pa.string() if isinstance(v[0], str) else pa.int64()) for v in out.values())], [*batch.schema.names, *out]
                )

    return read


_READ = "digest string, shard string, offset long, length long, width int, height int, depth int"


def read_payloads(index: DataFrame, folder: str) -> DataFrame:
    """`index` (with its header columns) with sizes, digests and features of the bytes as read back."""
    return index.mapInArrow(_payload_reader(folder), f"{_READ}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def _compacter(old: str, new: str):
    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = open_fs(old)
        name = f"shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
        cache: dict = {}
        out, at = None, 0
        for whole in batches:
            rows, offsets = whole.select(["digest", "shard", "offset", "length"]).to_pylist(), []
            for r in rows:
                if out is None:
                    target, top = open_fs(new)
                    target.create_dir(top, recursive=True)
                    out = target.open_output_stream(f"{top}/{name}", compression=None)
                info = tarfile.TarInfo(f"{r['digest'][:2]}/{r['digest']}.png")
                info.size = r["length"]
                head = info.tobuf(tarfile.USTAR_FORMAT)
                out.write(head + _open(cache, fs, root, r["shard"]).read_at(r["length"], r["offset"]) + bytes(-r["length"] % _BLOCK))
                offsets.append(at + len(head))
                at += len(head) + r["length"] + -r["length"] % _BLOCK
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array([name] * len(rows), pa.string()), pa.array(offsets, pa.int64()), whole.column(3)], ["digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(2 * _BLOCK))
            out.close()

    return copy


def compact(index: DataFrame, old: str, new: str, shards: int | None = None) -> DataFrame:
    """Copies the entries that `index` names from the shards in folder `old` to new ones in `new`, and returns their index: no digest has two entries there.

    Entries are dealt by shard and offset, so that a task reads long runs of a few shards;
    readers of `old` go on until its files are deleted. No entry, no shard.
    """
    own = index.select("digest", "shard", "offset", "length")
    dealt = own.repartitionByRange(shards or partitions(index.sparkSession), "shard", "offset").sortWithinPartitions("shard", "offset")
    return table(dealt.mapInArrow(_compacter(old, new), "digest string, shard string, offset long, length long"), "media-compact")


def payload_digest(text: Column, width: int = WIDTH) -> Column:
    """Digest of a text's payload, without Python."""
    raw = F.coalesce(text, F.lit(""))
    size = F.octet_length(raw)
    short = F.when(size == 0, F.lit(width)).otherwise(F.pmod(-size, F.lit(width)))
    return F.sha2(F.concat(raw, F.repeat(F.lit(" "), short)).cast("binary"), 256)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Per row of `docs`: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, width, height, shard, offset, length.

    Null texts count as empty: a payload of 192 spaces, n_bytes 0. Equal texts share one
    stored payload. Rows repeat as they do in `docs`; null ids stay; other columns are
    ignored.
    """
    folder = folder or new_folder(docs.sparkSession, "media")
    text = F.col(f"`{text_col}`").cast("string")
    index = read_headers(write_media(docs.select(text.alias("text")), folder), folder)
    stored = table(read_payloads(index, folder), "media-read")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), payload_digest(text).alias("digest"))
    return rows.join(stored, "digest").select(
        F.col("id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "shard", "offset", "length"
    )
