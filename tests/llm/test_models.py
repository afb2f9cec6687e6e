import random

import numpy as np
from pyspark.sql import functions as F

from freshet.llm import language_id, quality


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


LANGUAGES = {"xx": "la le mi no ta ré".split(), "yy": "sch ung ter ein ber ü".split(), "zz": "ing the er ed ly on".split()}


def documents(n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGUAGES))
        rows.append((i, prose(rng, LANGUAGES[lang], rng.randint(5, 60)), lang))
    return rows


def test_languages_are_told_apart(spark):
    rows = documents()
    extra = [(1000, None, "xx"), (1001, "123 !?", "xx"), (1002, "", None), (None, rows[0][1], None), (3, rows[3][1], rows[3][2]), (1003, "the " * 30_000, None)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("label", F.lit("clash")).withColumn("score", F.lit(9))
    out = {}
    for r in language_id.identify_languages(df).collect():
        out.setdefault(r["doc_id"], []).append(r)
    held = [r for i, _, lang in rows for r in out[i] if r["held_out"]]
    truth = {i: lang for i, _, lang in rows}
    assert len(held) > 50 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for rs in out.values() for r in rs)
    for i in (1000, 1001, 1002):
        assert (out[i][0]["lang_pred"], out[i][0]["score"]) == ("und", 0.0)
    assert out[1003][0]["lang_pred"] == "zz" and len(out[3]) == 2 and out[None][0]["lang_pred"] == out[0][0]["lang_pred"]


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.identify_languages(df).first()["lang_pred"] == "und"
    assert language_id.identify_languages(df.limit(0)).count() == 0
    assert language_id.keep_languages(df, None).count() == 0


def test_the_held_out_rule_is_crc32(spark):
    import zlib

    got = [r[0] for r in spark.range(50).select(language_id.held_out(F.col("id"), 4, 2)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)]


def test_ftrl_weights_are_sparse_and_separate():
    rows = [(np.array([i % 3, 5 + i % 7]), np.array([3.0, 0.05])) for i in range(300)]
    labels = np.array([i % 3 for i in range(300)])
    w, b = language_id.fit_ftrl(rows, labels, 3, l1=0.5)
    p = [np.argmax(x @ w[at] + b) for at, x in rows]
    assert np.mean(p == labels) == 1 and (w[5:12] == 0).mean() > 0.5 and not w[20:].any()


def junk(rng, n):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join([prose(rng, LANGUAGES["zz"], 1)] * n)
    if kind == 1:
        return " ".join(w + "###" for w in prose(rng, LANGUAGES["zz"], n).split())
    return " ".join(w.upper() + "!!" for w in prose(rng, LANGUAGES["zz"], n).split())


def test_quality_by_neighbours(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        rows.append((i, prose(rng, LANGUAGES["zz"], rng.randint(10, 60)) if good else junk(rng, rng.randint(10, 60))))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "the ing"), (1, rows[1][1])], "doc_id long, text string").withColumn("label", F.lit("clash"))
    marks = spark.createDataFrame(labels + [(5, None), (5, 1), (None, 1)], "doc_id long, quality int")
    out = quality.classify_quality(docs, marks).collect()
    truth = dict(labels)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert len(out) == 504 and len(held) > 50 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (900, 901)}) == 1
    none = quality.classify_quality(docs, marks.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.classify_quality(docs.limit(0), marks).count() == 0


def test_scores_are_those_of_all_cosines():
    rng = random.Random(1)
    texts = [prose(rng, LANGUAGES["zz"], 20) for _ in range(30)]
    counts = quality.term_counts(texts)
    idf = np.ones(quality.WIDTH, np.float32)
    basis = quality.latent_basis(quality.weighted(counts, idf), 8)
    vectors = quality.latent(quality.weighted(counts, idf), basis)
    labels = np.array([i % 2 for i in range(30)], float)
    model = quality.QualityModel(idf, basis, vectors, labels, neighbours=5)
    got = model.scores(texts[:4])
    for i in range(4):
        sims = [float(np.dot(vectors[i], v)) for v in vectors]
        best = sorted(range(30), key=lambda j: -sims[j])[:5]
        w = [max(sims[j], 1e-3) ** 8 for j in best]
        assert abs(got[i] - sum(x * labels[j] for x, j in zip(w, best, strict=True)) / sum(w)) < 1e-5


def plain_buckets(text):
    """Counts of the buckets of a text's 1- to 3-grams, one character at a time."""
    from collections import Counter

    mult, out = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), Counter()
    padded = text.lower() + "\n\n\n"
    for n in (1, 2, 3):
        for i in range(len(padded) - 3):
            h = n * 0x165667B1 & 0xFFFFFFFF
            for k in range(n):
                h = ((h ^ ord(padded[i + k]) * mult[k] & 0xFFFFFFFF) * 0x2545F491) & 0xFFFFFFFF
                h ^= h >> 15
            out[h >> (32 - language_id.BITS)] += 1
    return out


def test_language_scores_against_plain_loops(spark, monkeypatch):
    import math

    from freshet.llm import chargrams

    rng = np.random.default_rng(5)
    size = 1 << language_id.BITS
    idf, weights, bias = rng.uniform(1, 5, size), rng.normal(0, 1, (size, 3)) * (rng.random((size, 3)) < 0.3), rng.normal(0, 1, 3)
    model = language_id.LanguageModel(["a", "b", "c"], weights * idf[:, None], idf, bias, 1.7)
    texts = ["Ein Satz, ΣΑΣ und mehr.", "x", "", "ab " * 700, "日本語 text 12", "123", None, "é\n\nz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def plain(text):
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0
        counts = plain_buckets(text)
        total = sum(n * idf[b] for b, n in counts.items())
        z = [sum(20.0 * n * idf[b] / total * weights[b, j] for b, n in counts.items()) + bias[j] for j in range(3)]
        e = [math.exp((v - max(z)) / 1.7) for v in z]
        return "abc"[int(np.argmax(z))], max(e) / sum(e)

    for piece in (None, 64):  # texts whole, and long ones in pieces
        if piece:
            monkeypatch.setattr(chargrams, "PIECE", piece)
            assert np.allclose(model.logits([texts[3]]), whole)
        whole = model.logits([texts[3]])
        got = {r["doc_id"]: r for r in language_id.predict_language(df, model).collect()} if piece is None else got
        for i, t in enumerate(texts):
            name, score = plain(t)
            assert got[i]["lang_pred"] == name and abs(got[i]["score"] - score) < 1e-3, t
    for t in texts[:5]:
        counted = language_id._counts(t)
        assert {int(b): int(counted[b]) for b in np.flatnonzero(counted)} == dict(plain_buckets(t))


def test_updates_against_a_plain_loop():
    rng = np.random.default_rng(3)
    rows, labels = [], rng.integers(0, 3, 12)
    for _ in range(12):
        at = np.sort(rng.choice(40, 5, replace=False))
        rows.append((at, rng.uniform(0, 4, 5)))
    w, bias = language_id.fit_ftrl(rows, labels, 3, epochs=2)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.02
    z, n = {}, {}

    def weight(key):
        zi = z.get(key, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((beta + n.get(key, 0.0) ** 0.5) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(12):
            features = [*zip(rows[i][0].tolist(), rows[i][1].tolist(), strict=True), ("bias", 1.0)]
            logits = np.array([sum(x * weight((b, c)) for b, x in features) for c in range(3)])
            p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            new = {}
            for b, x in features:
                for c in range(3):
                    g = x * (p[c] - (labels[i] == c))
                    old = n.get((b, c), 0.0)
                    new[b, c] = (z.get((b, c), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / alpha * weight((b, c)), old + g * g)
            for key, (zi, ni) in new.items():
                z[key], n[key] = zi, ni
    assert all(abs(w[b, c] - weight((b, c))) < 1e-9 for b in range(40) for c in range(3))
    assert all(abs(bias[c] - weight(("bias", c))) < 1e-9 for c in range(3)) and not w[40:].any()


def test_quality_terms_of_a_long_text_are_those_of_its_pieces(monkeypatch):
    from freshet.llm import chargrams

    texts = ["Some words, 12 of them. " * 40, "short", "", "ÄÖ x" * 300]
    whole = quality.term_counts(texts)
    monkeypatch.setattr(chargrams, "PIECE", 50)
    assert (quality.term_counts(texts) == whole).all()


def test_repeated_ids_bring_no_more_rows_than_the_sample(spark):
    docs = spark.createDataFrame([(1, "good text here")] * 50 + [(1, "a text"), (2, "bad bad bad"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    model = quality.fit_quality_model(docs, labels)
    assert len(model.labels) == 3
    assert quality.score_quality(docs, model).count() == 53
