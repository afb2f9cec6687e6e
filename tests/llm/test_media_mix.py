import hashlib
import tarfile
import zlib
from collections import Counter
from math import exp

import pytest
from pyspark.sql import functions as F

from freshet.llm import media, mixing


def test_payloads_come_back(spark, tmp_path):
    texts = ["", None, "a", "é" * 96, "x" * 192, "x" * 193, "long " * 50_000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "b"), (2, "a")], "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("shard", F.lit("clash"))
    folder = f"file://{tmp_path}/m"
    rows = media.media_columns(df.repartition(3), folder=folder).collect()
    assert len(rows) == 10
    for r in rows:
        text = "b" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        payload = media.pad(text.encode())
        assert len(payload) % 192 == 0 and payload.rstrip(b" ") == text.encode().rstrip(b" ")
        with open(f"{tmp_path}/m/{r['shard']}", "rb") as f:
            f.seek(r["offset"])
            stored = f.read(r["length"])
        assert media.decode_png(stored) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload))
        assert (r["width"], r["height"]) == (192, len(payload) // 192)
    assert len({(r["shard"], r["offset"]) for r in rows if r["doc_id"] in (2, 7)}) == 1  # equal texts, one address
    for shard in {r["shard"] for r in rows}:
        with tarfile.open(f"{tmp_path}/m/{shard}") as tar:
            for info in tar:
                assert hashlib.sha256(media.decode_png(tar.extractfile(info).read())).hexdigest() in info.name
    assert media.media_columns(df.limit(0)).count() == 0


def test_damage_is_noticed():
    data = bytearray(media.encode_png(media.pad(b"abc")))
    data[50] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(data))
    with pytest.raises(ValueError):
        media.png_header(b"no" * 20)


def draws(rows, rates, seed="mix-1"):
    out = Counter()
    for i, domain in rows:
        u = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52
        lam, k = rates[domain], 0
        term = total = exp(-lam)
        while total <= u and lam:
            k += 1
            term *= lam / k
            total += term
        out[i] += k
    return out


def test_copies_follow_the_inverse_distribution(spark):
    rows = [(i, "abc"[min(2, i % 7 // 2)] if i % 11 else None, "x" * (i % 5 + 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("copy", F.lit("clash"))
    rates = {r["domain"]: r["rate"] for r in mixing.domain_rates(df).collect()}
    out = mixing.mix(df).collect()
    want = draws([(i, s) for i, s, _ in rows], rates)
    assert Counter(r["doc_id"] for r in out) == Counter({i: n for i, n in want.items() if n})
    assert sorted(r["position"] for r in out) == list(range(len(out)))
    keys = [hashlib.md5(f"mix-1 order:{r['doc_id']}:{r['copy']}".encode()).hexdigest() for r in sorted(out, key=lambda r: r["position"])]
    assert keys == sorted(keys)
    size = Counter()
    for r in out:
        size[r["source"]] += len(r["text"])
    total = sum(len(t) for _, _, t in rows)
    assert abs(sum(size.values()) - total) < 0.1 * total


def test_given_weights_high_rates_and_edges(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y" * 5000), (None, None, None), (3, "b", "")], "doc_id long, source string, text string")
    rates = {r["domain"]: r for r in mixing.domain_rates(df, weights={"a": 1.0}).collect()}
    assert rates["a"]["rate"] == 5001.0 and rates["b"]["rate"] == 0.0 and abs(rates["a"]["cdf"][-1] - 1) < 1e-6
    n = mixing.mix(df, weights={"a": 1.0}).groupBy("doc_id").count().collect()
    assert len(n) == 1 and n[0]["doc_id"] == 1 and 4600 < n[0]["count"] < 5400
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.where("text is null")).columns == ["doc_id", "source", "text", "copies", "copy", "position"]


def test_a_digest_met_by_two_tasks_has_one_address_and_compaction_drops_the_other(spark, tmp_path):
    import tarfile

    old, new = f"file://{tmp_path}/old", f"file://{tmp_path}/new"
    rows = [("same",), ("one",), ("two",), ("same",), (None,), ("",)]
    texts = spark.createDataFrame(spark.sparkContext.parallelize(rows, 2), "text string")
    index = media.table(media.write_media(texts, old), "index")
    names = lambda folder: [m.name for f in sorted((tmp_path / folder).glob("*.tar")) for m in tarfile.open(f)]
    assert index.count() == 4 and len(names("old")) == 5
    moved = media.compact(index, old, new, shards=2)
    assert sorted(names("new")) == sorted({n for n in names("old")}) and moved.count() == 4
    read = lambda at, folder: sorted((r["digest"], r["payload_sha256"], r["media_sha256"]) for r in media.read_payloads(media.read_headers(at, folder), folder).collect())
    assert read(moved, new) == read(index, old) and all(d == p for d, p, _ in read(moved, new))
    assert media.compact(index.limit(0), old, new).count() == 0
