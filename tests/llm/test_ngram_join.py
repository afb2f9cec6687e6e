import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from freshet.llm import ngram_join, textkit
from freshet.llm.components import components


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, n=5, threshold=0.8):
    """(class id, links) of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {("short", *w)} if w else {("raw", t)} if t else set())
    links = [[j for j, b in enumerate(sets) if j != i and a and b and len(a & b) >= threshold * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    least = [r[0] for r in rows]
    for _ in rows:
        least = [min([least[i], *[least[j] for j in links[i]]]) for i in range(len(rows))]
    return [(rows[i][0], least[i], len(links[i])) for i in range(len(rows))]


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 80, 300]))] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:
        for _ in range(rng.randint(1, 6)):
            c = list(b)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c))
    texts += [texts[0]] * 5 + [texts[0].upper(), "one", "one", "One!", "two words", "!!!", "!!!", "???", "", None, "x" * 50_000, "x " * 30_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_all_links_and_classes(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("cluster", F.lit(2))
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_classes(df).collect())
    assert got == brute(rows)


def test_clusters_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 3)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_classes(df).collect())
    assert got == brute(rows)


def test_repeated_and_null_ids_and_no_rows(spark):
    t = " ".join("abcdefghij")
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, None), (3, "other words here"), (3, "quite another text")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_classes(df).collect()), key=str)
    assert got == sorted([(1, 1, 3), (1, 1, 3), (2, 1, 3), (None, 1, 3), (None, None, 0), (3, 3, 0), (3, 3, 0)], key=str)
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_join.one_of_each_class(df).collect()), key=str)
    assert kept == sorted([(1, t), (None, None), (3, "other words here"), (3, "quite another text")], key=str) or len(kept) == 4 + 1
    assert ngram_join.ngram_jaccard_classes(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.99), (0.95, 0.9)):
        bands, rows = ngram_join.plan_bands(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 256
    with pytest.raises(ValueError):
        ngram_join.plan_bands(0.1, 0.999999, most=4)


def test_words_as_the_pattern_finds_them():
    texts = ["It's ÜBER-cool_x 42\u00a0a", "", None, "a", "日本 語", "tab\tnew\nline", "z" * 10 + " " + "y" * 5]
    h, b = textkit.word_hashes(pa.array(texts, pa.string()))
    assert np.diff(b).tolist() == [len(words(t)) for t in texts]
    same = {}
    for t, lo, hi in zip(texts, b, b[1:], strict=False):
        for w, x in zip(words(t), h[lo:hi], strict=True):
            assert same.setdefault(w, x) == x
    assert len(set(same.values())) == len(same)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(textkit.segments, "__defaults__", (64,))
    rng = random.Random(1)
    texts = [" ".join("w" * rng.randint(1, 90) for _ in range(40)) for _ in range(5)] + ["short"]
    h, b = textkit.word_hashes(pa.array(texts))
    monkeypatch.undo()
    g, c = textkit.word_hashes(pa.array(texts))
    assert b.tolist() == c.tolist() and (h == g).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(50, 51), (51, 50), (60, 60), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 51: 50}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_a_cluster_of_more_blocks_than_bands_is_compared_band_by_band(spark, monkeypatch):
    rng = random.Random(31)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(70):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.ngram_jaccard_classes(df).collect()))
    assert max(r[2] for r in want) > 20
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 2)
    assert sorted(map(tuple, ngram_join.ngram_jaccard_classes(df).collect())) == want
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    assert sorted(map(tuple, ngram_join.ngram_jaccard_classes(df).collect())) == want


def test_repeated_ids_and_null_ids_keep_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near = text.replace("w39", "y")
    rows = [(1, text), (1, text), (1, near), (2, near), (None, text), (None, "alone " * 9), (None, "alone " * 9), (3, None), (3, None), (4, ""), (5, "...")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit("clash")).withColumn("k", F.lit(0))
    kept = ngram_join.one_of_each_class(df).collect()
    assert len([r for r in kept if r["doc_id"] == 1]) == 1 and [r for r in kept if r["doc_id"] == 1][0]["text"] in (text, near)
    assert sorted((str(r["doc_id"]), str(r["text"])[:5]) for r in kept if r["doc_id"] != 1) == [("3", "None"), ("4", ""), ("5", "..."), ("None", "alone")]
    assert kept[0].__fields__ == df.columns


def test_consumed_tables_are_deleted_and_bitmaps_lose_nothing(spark, tmp_path):
    from pathlib import Path

    from freshet.llm import runtime

    kept = runtime.table(spark.range(5), "kept")
    place = Path(runtime._PLACES[kept].removeprefix("file://").removeprefix("file:"))
    assert place.exists()
    runtime.discard(kept, spark.range(3))
    assert not place.exists()
    rows = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    members = rows.where("id % 50 = 0").select("h")
    marked = runtime.maybe_in(rows, F.col("h"), members, 400, "maybe")
    got = marked.agg(F.count("*").alias("n"), F.count_if(F.col("maybe") & (F.col("id") % 50 == 0)).alias("hits"), F.count_if("maybe").alias("passed")).first()
    assert (got["n"], got["hits"]) == (20_000, 400) and got["passed"] < 2_500
    groups = spark.createDataFrame([(0, "a", 900), (1, "b", 3), (9, "c", 0)], "k int, v string, size int")
    every = spark.range(1000).select(F.when(F.col("id") < 900, 0).when(F.col("id") < 903, 1).otherwise(5).alias("k"), "id")
    joined = runtime.join_groups(every, groups, ["k"], "size", 1000)
    assert {r["v"]: r["count"] for r in joined.groupBy("v").count().collect()} == {"a": 900, "b": 3}
