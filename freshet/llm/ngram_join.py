"""Join of a table with itself on the Jaccard similarity of its texts' word n-grams (operator 3).

Method: MinHash signatures cut into bands; documents that agree in a band are candidates;
candidates are verified on their full n-gram sets. The numbers of bands and rows follow
from the recall that is asked for at the threshold.

Equal n-gram sets are one class from the start, so copies are never paired with each
other. Candidate classes are grouped into clusters by linking each band's members to the
least of them (as many links as members), so that a text is shuffled once, whatever the
number of its bands. Clusters are cut into blocks of bounded size, and each task compares
the sets of two blocks, of those pairs only that agree in a band. A cluster of more blocks
than there are bands is compared band by band instead. A task returns one row per class: its
links, and a representative of what it is linked to; pairs are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import textkit
from freshet.llm.components import components
from freshet.llm.runtime import discard, join_groups, maybe_in, partitions, table

BLOCK_CLASSES = 768
BLOCK_SHINGLES = 400_000
_COLUMNS = 4096
PART_BYTES = 3 << 20  # of text, hashed at once


def plan_bands(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, within `most` hash functions and the recall of a pair just at the threshold."""
    best = None
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands within the number of hash functions")
    return best


def _hashers(count: int, seed: int = 0x5EED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 32, count, dtype=np.uint64).astype(np.uint32)
    return draw(), draw() | np.uint32(1)


def _sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return textkit.shingle_hashes(*textkit.word_hashes(texts), n)


def _class_key(grams: np.ndarray) -> bytes:
    """128 bits of a set of n-grams (sorted, distinct)."""
    salted = textkit.mix(grams ^ np.uint64(0x94D049BB133111EB))
    return np.array([grams.sum(dtype=np.uint64) ^ np.uint64(len(grams)), salted.sum(dtype=np.uint64)], np.uint64).tobytes()


def _signer(n: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flip, times = _hashers(bands * rows)
        weights = np.array([pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) for i in range(rows)], np.uint64)
        for whole in batches:
            for batch in textkit.by_bytes(whole, PART_BYTES):
                texts = batch.column(1)
                grams, bound = _sets(texts, n)
                have = np.diff(bound)
                full = np.flatnonzero(have)
                low = (grams >> np.uint64(32)).astype(np.uint32)
                sign = np.zeros((bands, len(batch)), np.uint64)
                work = np.empty_like(low)
                for k in range(bands * rows if len(full) else 0):
                    np.bitwise_xor(low, flip[k], out=work)
                    np.multiply(work, times[k], out=work)
                    sign[k // rows, full] += (np.minimum.reduceat(work, bound[full]).astype(np.uint64) + np.uint64(1)) * weights[k % rows]
                sign = textkit.mix(sign.ravel()).reshape(sign.shape)
                keys, sizes = [], np.zeros(len(batch), np.int64)
                for i in range(len(batch)):
                    if have[i]:
                        own = np.unique(grams[bound[i] : bound[i + 1]])
                        sizes[i] = len(own)
                        keys.append(_class_key(own))
                    else:  # no word: a class of its own text
                        text = texts[i].as_py()
                        keys.append(None if not text else b"raw" + text.encode()[:13] if len(text.encode()) <= 13 else b"long" + np.array([hash_bytes(text.encode())], np.uint64).tobytes() + len(text).to_bytes(4, "little"))
                flat = sign.T.reshape(-1).view(np.int64)
                offs = np.concatenate(([0], np.cumsum(np.where(have > 0, bands, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat[np.repeat(have > 0, bands)]))],
                    ["id", "th", "k", "n", "bands"],
                )

    return sign


def hash_bytes(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted arrays of distinct values, in memory bounded by rows x rows."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1 if len(values) else fresh
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.concatenate(([0], np.diff(column) > 0))) if len(column) else column
    total = np.zeros((m, m), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, _COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + _COLUMNS])
        part = np.zeros((m, min(_COLUMNS, width - lo)), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part @ part.T
    return total


def sharing(bands: np.ndarray, band: int) -> np.ndarray:
    """Which pairs agree in some band; if `band` is not -1, those of which it is the first such."""
    out = np.zeros((len(bands), len(bands)), bool)
    for b in range(bands.shape[1]):
        own = bands[:, b]
        same = own[:, None] == own[None, :]
        if b == band:
            return same & ~out
        out |= same
    return out


def _linked(keys: list[bytes], side: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, list[bytes]]:
    """Links and the least linked key of each class; side 2: compare with all of its kind, else only 0 with 1."""
    near = sharing(bands, band)
    size = np.array([len(s) for s in sets], np.float64)
    both = intersections(sets)
    near &= both >= threshold * (size[:, None] + size[None, :] - both) - 1e-6
    near &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    np.fill_diagonal(near, False)
    links = near @ copies.astype(np.float64)
    root = np.argsort(np.argsort(np.array(keys, dtype=object)))
    while True:  # labels of the connected parts
        least = np.where(near, root[None, :], len(keys)).min(axis=1) if len(keys) else root
        new = np.minimum(root, least)
        if (new == root).all():
            break
        root = new
    ordered = sorted(keys)
    return links.astype(np.int64), [ordered[r] for r in root]


_GROUP = ["cluster", "band", "bi", "bj"]


def _verifier(n: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def close():
            keys = list(held)
            side, copies, sets, bands = zip(*held.values(), strict=True) if held else ((), (), (), ())
            links, root = _linked(keys, np.array(side), np.array(copies), list(sets), np.array(bands, np.int64).reshape(len(keys), -1), group[1], threshold)
            some = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), pa.array(links[some], pa.int64()), pa.array([root[i] for i in some], pa.binary()), pa.array(np.full(len(some), group[4]), pa.bool_())], ["k", "links", "lead", "split"])

        for batch in (part for whole in batches for part in textkit.by_bytes(whole, PART_BYTES, whole.schema.get_field_index("text"))):
            grams, bound = _sets(batch.column("text"), n)
            rows = batch.drop_columns(["text"]).to_pylist()
            for i, row in enumerate(rows):
                at = (*(row[c] for c in _GROUP), row["split"])
                if at != group:
                    if group is not None:
                        yield close()
                    group, held = at, {}
                own = np.unique(grams[bound[i] : bound[i + 1]])
                if row["k"] not in held and len(own) and _class_key(own) == row["k"]:
                    held[row["k"]] = (2 if row["bi"] == row["bj"] else int(row["block"] == row["bj"]), row["copies"], own, row["bands"])
        if group is not None:
            yield close()

    return verify


def _row_key(own: Column) -> Column:
    """An id as text that tells null from all others."""
    return F.concat_ws(":", own.isNull().cast("int").cast("string"), own.cast("string"))


def _blocks(classes: str, grams: str) -> Column:
    return F.greatest(F.ceil(F.col(classes) / BLOCK_CLASSES), F.ceil(F.col(grams) / BLOCK_SHINGLES)).cast("int")


def _classes(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, recall: float, most_hashes: int) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """(id, th, k) of every row, (k, class_id, class_th, n_links, n_copies) of every k, both written, the number of rows that have a k, and the table that the first is of.

    th is a hash of the text: an id and th are a row but for equal rows.
    """
    bands, rows = plan_bands(threshold, recall, most_hashes)
    own: Column = F.col(f"`{id_col}`")
    kind = docs.select(own.alias("id")).schema["id"].dataType.simpleString()
    text = F.col(f"`{text_col}`").cast("string")
    source = docs.select(own.alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    signed = table(source.mapInArrow(textkit.tidy(_signer(n, bands, rows)), f"id {kind}, th long, k binary, n long, bands array<long>"), "signed")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("th")))
    classes = table(signed.where("k is not null").groupBy("k").agg(first.alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    sizes = classes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()

    # 64 bits of a class are enough to bring candidates together; what is equal is decided on all of k
    in_band = classes.select(F.xxhash64("k").alias("c"), "n", F.posexplode("bands").alias("band", "h"))
    buckets = table(in_band.groupBy("band", "h").agg(F.min("c").alias("lead"), F.count("*").alias("many"), F.sum("n").alias("grams")).where("many > 1"), "buckets")
    edges = join_groups(in_band.select("c", "band", "h"), buckets.select("band", "h", "lead", "many"), ["band", "h"], "many", sizes["classes"] * bands)
    cluster = table(components(edges.where("c <> lead").select(F.col("c").alias("u"), F.col("lead").alias("v"))).select(F.col("node").alias("c"), F.col("root").alias("cluster")), "clusters")

    member = classes.withColumn("c", F.xxhash64("k")).join(cluster, "c").drop("c")
    size = member.groupBy("cluster").agg(F.count("*").alias("many"), F.sum("n").alias("grams")).withColumn("nb", _blocks("many", "grams"))
    members = cluster.count()
    member = table(join_groups(member, size.drop("grams"), ["cluster"], "many", members), "members")
    key = member.select(_row_key(F.col("rep.id")).alias("rk"), F.col("rep.th").alias("th"), "k", "copies", "bands", "cluster", "nb")
    found_rows = maybe_in(source.withColumn("rk", _row_key(F.col("id"))), F.xxhash64("rk", "th"), key.select(F.xxhash64("rk", "th").alias("h")), members, "maybe")
    texts = key.join(found_rows.where("maybe").select("rk", "th", "text").dropDuplicates(["rk", "th"]), ["rk", "th"]).drop("rk", "th")
    # a cluster of few blocks: all blocks with all
    few = texts.where(F.col("nb") <= bands).withColumn("block", F.expr("cast(pmod(xxhash64(k), nb) as int)")).withColumn("band", F.lit(-1)).withColumn("cluster", F.col("cluster").cast("string"))
    # one of many: the blocks of each of its bands
    wide = join_groups(member.where(F.col("nb") > bands).select("k", F.posexplode("bands").alias("band", "h")), buckets.select("band", "h", "many", "grams"), ["band", "h"], "many", members * bands)
    wide = wide.select("k", "band", F.concat_ws(":", "band", "h").alias("bucket"), _blocks("many", "grams").alias("own_nb"))
    many = texts.where(F.col("nb") > bands).drop("nb", "cluster").join(wide, "k").withColumnsRenamed({"bucket": "cluster", "own_nb": "nb"}).withColumn("block", F.expr("cast(pmod(xxhash64(k), nb) as int)"))
    columns = ["cluster", "band", "nb", "block", "k", "copies", "bands", "text"]
    both = few.select(*columns)
    if member.where(F.col("nb") > bands).limit(1).count():
        both = both.unionByName(many.select(*columns))
    dealt = both.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select(
        "cluster", "band", "block", "k", "copies", "bands", "text", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), ((F.col("nb") > 1) | (F.col("band") >= 0)).alias("split")
    )
    dealt = dealt.repartition(partitions(docs.sparkSession), *_GROUP).sortWithinPartitions(*_GROUP, "k")
    found = table(dealt.mapInArrow(textkit.tidy(_verifier(n, threshold)), "k binary, links long, lead binary, split boolean"), "links")
    discard(buckets, cluster, member)

    whole = found.where("not split").select("k", F.col("lead").alias("root"))
    parts = components(found.where("split").select(F.col("k").alias("u"), F.col("lead").alias("v"))).select(F.col("node").alias("k"), "root")
    root = whole.unionByName(parts).distinct()
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    named = classes.select("k", "rep", "copies").join(root, "k", "left").join(links, "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = named.groupBy("root").agg(F.min("rep").alias("first"), F.count("*").alias("size"))
    named = join_groups(named, least, ["root"], "size", sizes["classes"])
    named = table(named.select("k", F.col("first.id").alias("class_id"), F.col("first.th").alias("class_th"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("copies").alias("n_copies")), "named")
    discard(classes, found)
    return signed.select("id", "th", "k"), named, sizes["rows"], signed


def ngram_jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, most_hashes: int = 96) -> DataFrame:
    """(id, class_id, n_links, n_copies) for every row of `docs`.

    class_id is the least id among the documents linked to it directly or through others;
    n_links counts the other rows whose n-gram set has a Jaccard similarity of `threshold`
    or more with its own (equal sets among them); n_copies counts rows with an equal set.
    Texts of fewer than n words have one gram, all their words. Texts without a word are
    linked to equal texts only; null and empty texts to none. Rows with a null id are
    counted like others (their class_id is the least non-null id, else null). Repeated rows
    each return. Other columns of `docs` are ignored, whatever their names. A pair just at
    the threshold is a candidate (agrees in a band) with probability `recall` or more; what
    is a candidate is compared exactly.
    """
    signed, named, rows, _ = _classes(docs, id_col, text_col, n, threshold, recall, most_hashes)
    classed = join_groups(signed.where("k is not null").select("id", "k"), named.drop("class_th"), ["k"], "n_copies", rows)
    alone = signed.where("k is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return classed.drop("k").unionByName(alone).withColumnRenamed("id", id_col)


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999, most_hashes: int = 96) -> DataFrame:
    """`docs` without the rows that are not the first of their class; rows repeated under one id and text stay once.

    The first has the least id (of one id, the text with the least hash); a null id comes
    after all others. Columns stay as they are, whatever their names. Texts that stay are
    not shuffled, but for the few that a bitmap cannot tell from those that go.
    """
    signed, named, rows, written = _classes(docs, id_col, text_col, n, threshold, recall, most_hashes)
    classed = join_groups(signed.where("k is not null"), named.select("k", "class_id", "class_th", "n_copies"), ["k"], "n_copies", rows)
    goes = ~(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th")))
    every = classed.select("id", "th", goes.alias("goes")).unionByName(signed.where("k is null").select("id", "th", F.lit(False).alias("goes")))
    flagged = every.groupBy(_row_key(F.col("id")).alias("__rk"), F.col("th").alias("__th")).agg(F.max("goes").alias("__goes"), F.count("*").alias("__many")).where("__goes or __many > 1")
    flagged = table(flagged, "flagged")
    discard(written, named)
    known = flagged.agg(F.count("*").alias("keys"), F.coalesce(F.sum("__many"), F.lit(0)).alias("rows"), F.count_if(~F.col("__goes")).alias("repeated")).first()
    if not known["keys"]:
        return docs
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn("__rk", _row_key(own)).withColumn("__th", F.xxhash64(text))
    marked = maybe_in(marked, F.xxhash64("__rk", "__th"), flagged.select(F.xxhash64("__rk", "__th").alias("h")), known["keys"], "__maybe")
    free = marked.where(~F.col("__maybe"))
    suspect = marked.where("__maybe").join(flagged.select("__rk", "__th"), ["__rk", "__th"], "left_anti")
    out = free.unionByName(suspect).select(*columns)
    if known["repeated"]:
        again = marked.where("__maybe").join(flagged.where(~F.col("__goes")).select("__rk", "__th"), ["__rk", "__th"], "left_semi")
        out = out.unionByName(again.dropDuplicates(["__rk", "__th"]).select(*columns))
    return out
