import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from freshet.llm import decontaminate as D
from freshet.llm import licenses as L
from freshet.llm import textkit
from freshet.llm import url_filter as U


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def standing(joined):
    """(begin, end, label, confidence) of all matches of all rules, without any prefilter, that lie in no other of the same or a higher priority."""
    found = []
    for p in {r[0] for r in L.rules()}:
        own = [(label, re.compile(pattern), sure) for q, label, pattern, sure in L.rules() if q == p]
        for at in (m.start() for m in re.finditer(" ", joined)):
            hit = next(((m, label, sure) for label, pattern, sure in own if (m := pattern.match(joined, at))), None)
            if hit:
                found.append((at, hit[0].end(), p, hit[1], hit[2]))
    return sorted((f[0], f[1], f[3], f[4]) for f in found if not any(g is not f and g[0] <= f[0] and g[1] >= f[1] and g[2] <= f[2] for g in found))


def scan(text):
    """Base columns by a plain loop, labels by the rules in order."""
    ws = words(text)
    places = []
    for phrase, label in L.BASE_PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    base = sorted({label for _, label in places})
    spots = standing(f" {' '.join(ws)} ")
    labels = sorted({*base, *(s[2] for s in spots)})
    best = max([0.8 if base else 0.0, *(s[3] for s in spots)])
    return (len(ws), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(base), ",".join(labels), best), spots


def test_license_rules_against_a_loop(spark):
    rng = random.Random(4)
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "CC BY-NC 4.0", "cc-by-nc cc by nc", "SPDX-License-Identifier: BSD-3-Clause", "GNU General Public License v3", "under the mit licenses", "https://creativecommons.org/licenses/by-sa/4.0/", "Apache License Version 2", "the ISC license", "plain words", "Ünder the MIT License", "MIT", "cc", "licensed under CC BY-NC-SA 4.0", "under the terms of the Mozilla Public License 2.0", "K license", "gpl 2 license zlib", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or", "To the extent possible under law, A B has waived all copyright and related or neighboring rights to"]
    texts = ["", None, "under the MIT license " * 400] + [rng.choice([" ", "\n", ", ", "-"]).join(rng.choice(lines) for _ in range(rng.randint(1, 8))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "mit license"), (3, texts[3])], "doc_id long, text string").withColumn("words", F.lit("clash")).withColumn("found", F.lit(1))
    out = L.scan_licenses(df)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in out.collect() if r["doc_id"] is not None}
    spots = {r["doc_id"]: [tuple(d) for d in r["detections"]] for r in out.collect()}
    for i, t in enumerate(texts):
        want, where = scan(t)
        assert got[i] == want and spots[i] == where, t
    assert out.count() == len(texts) + 2 and L.scan_licenses(df.limit(0)).count() == 0
    assert len(L.rules()) >= 300 and len(L.NOTICES) >= 50
    assert len(spots[2]) == 400


def test_many_notices_in_one_text_take_time_in_proportion(spark):
    import time

    line, took = "Released under the MIT license; gpl 2 license zlib. ", {}
    each = len(scan(line * 7)[1]) // 7
    for n in (2_000, 10_000, 40_000):
        df = spark.createDataFrame([(1, line * n)], "doc_id long, text string")
        began = time.time()
        r = L.scan_licenses(df).select("n_base", "labels", F.size("detections").alias("n")).first()
        took[n] = time.time() - began
        assert (r["n_base"], r["labels"]) == (n, "gpl-2.0,mit,zlib") and r["n"] == each * n
    assert took[40_000] < 6 * took[10_000] + 10


def test_every_spelling_of_a_license_is_found_as_without_any_prefilter(spark):
    rng = random.Random(8)

    def spelled(pattern, whole):
        pattern = re.sub(r"\(\?:([^()]*)\)\?", lambda m: rng.choice(m[1].split("|")) if whole else "", pattern)
        pattern = re.sub(r"\(\?:([^()]*)\)", lambda m: rng.choice(m[1].split("|")), pattern)
        return re.sub(r"(.)\?", r"\1" if whole else "", re.sub(r"\[cs\]", "c", pattern))

    texts = [("gpl-3.0", "GNU General Public License v3"), ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"), ("gpl-2.0", "license: GPLv2")]
    for label, *_, name, short, address in L.LICENSES:
        for whole in (False, True):
            texts += [(label, f"the {spelled(name, whole)} license"), (label, f"{spelled(short, whole)} license"), (label, f"available under a {spelled(rng.choice([name, short]), whole)}"), (label, f"see {address} there")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan_licenses(df).collect()}
    for i, (label, text) in enumerate(texts):
        want, spots = scan(text)
        assert [tuple(d) for d in got[i]["detections"]] == spots, text
        assert got[i]["labels"] == want[5] and label in want[5].split(","), text


def test_every_rule_has_its_keywords_in_all_its_spellings(spark):
    rng = random.Random(11)
    for _, label, keys, pattern in L.signatures():
        spellings = sorted(L._spellings(pattern))
        for text in rng.sample(spellings, min(20, len(spellings))):
            assert keys == ("spdx",) or set(text.split()) & set(keys), (label, text)
            if "{" not in pattern:
                assert re.fullmatch(pattern, text), (label, text)
    notices = [(i, pattern) for i, (_, pattern) in enumerate(L.NOTICES)]
    texts = [(i, rng.choice(sorted(L._spellings(p.replace(".{1,80}?", "Some One ").replace(".{1,60}?", "thing "))))) for i, p in notices]
    got = {r["doc_id"]: r["labels"].split(",") for r in L.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(L.NOTICES[i][0] in got[i] for i, _ in texts), [(t, got[i]) for i, t in texts if L.NOTICES[i][0] not in got[i]]


def overlaps(doc, item, least=12, identity=0.75):
    """Agreeing words of the best overlap of all diagonals that have a seed."""
    best = None
    for shift in range(-len(item) + 1, len(doc)):
        inside = [j for j in range(len(item)) if 0 <= shift + j < len(doc)]
        same = np.array([doc[shift + j] == item[j] for j in inside], bool)
        care = [[k for k, c in enumerate(mask) if c == "1"] for mask in D.MASKS]
        if not any(all(same[j + k] for k in ks) for mask, ks in zip(D.MASKS, care, strict=True) for j in range(len(same) - len(mask) + 1)):
            continue
        runs = [(int(same[a:b].sum()) * 3 - 2 * (b - a), -a, b, int(same[a:b].sum())) for a in range(len(same)) for b in range(a + 1, len(same) + 1)]
        top = max(runs)[0]
        _, a, b, n = min((r for r in runs if r[0] == top), key=lambda r: (r[2], -r[1]))
        if n < least or n < identity * (b + a):
            n = max((r[3] for r in runs if r[3] >= least and r[3] >= identity * (r[2] + r[1])), default=0)
        best = max(best or 0, n) or None
    return best


def test_overlaps_against_all_diagonals(spark):
    rng = random.Random(7)
    v = [f"w{i}" for i in range(300)]
    items = [[rng.choice(v) for _ in range(rng.choice([8, 15, 20, 40]))] for _ in range(12)]
    docs = []
    for i in range(60):
        d = [rng.choice(v) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            part = list(rng.choice(items))
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = "changed"
            part = part[rng.randint(0, 3) :]
            at = rng.randint(0, len(d))
            d[at:at] = part
        docs.append(d)
    df = spark.createDataFrame([(i, " ".join(d).upper() + ".") for i, d in enumerate(docs)] + [(100, None), (101, "")], "doc_id long, text string").withColumn("item", F.lit("clash"))
    tests = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["matched_words"] for r in D.find_overlaps(df, tests).collect()}
    want = {(i, j): n for i, d in enumerate(docs) for j, t in enumerate(items) if (n := overlaps(d, t))}
    assert got == want and len(want) >= 8
    kept = {r["doc_id"] for r in D.decontaminate(df, tests).collect()}
    assert kept == ({*range(60)} | {100, 101}) - {i for i, _ in want}
    assert D.find_overlaps(df.limit(0), tests).count() == 0 and D.find_overlaps(df, tests.limit(0)).count() == 0


def test_a_run_that_qualifies_is_found_inside_a_longer_one_that_does_not(spark):
    rng = random.Random(5)
    for _ in range(300):
        same = np.array([rng.random() < rng.choice([0.6, 0.75, 0.9]) for _ in range(rng.randint(0, 45))], bool)
        good = [int(same[a:b].sum()) for a in range(len(same)) for b in range(a + 1, len(same) + 1) if same[a:b].sum() >= max(12, 0.75 * (b - a))]
        run = D.longest_run(same, 12, 0.75)
        assert (run is None) == (not good)
        if run:
            n = int(same[run[0] : run[1]].sum())
            assert n == max(good) and n >= 0.75 * (run[1] - run[0])
    rows, items = [], []
    for i in range(20):
        item = [f"x{i}w{k}" for k in range(400)]
        # 25 % and more substituted; only the first 16 words agree as they should
        rows.append((i, " ".join(w if k < 16 or k % 10 in (0, 1, 2, 4, 7, 8, 9) else "other" for k, w in enumerate(item))))
        items.append((i, " ".join(item)))
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched_words"], r["run_words"]) for r in D.find_overlaps(docs, tests).collect()}
    assert got.keys() == {(i, i) for i in range(20)} and all(m >= 12 and m >= 0.75 * n for m, n in got.values())
    assert D.decontaminate(docs, tests).count() == 0


def test_repeated_words_and_long_items_take_no_square_of_time(spark):
    import time

    rng = random.Random(12)
    long_item = " ".join(f"t{rng.randrange(10_000)}" for _ in range(20_000))
    docs = [(0, "same " * 50_000), (1, "one two three four five six seven " * 6_000), (2, f"before {long_item} after"), (3, None), (3, "same " * 12)]
    items = [(0, "same " * 3_000), (1, "one two three four five six seven " * 400), (2, long_item), (2, "same " * 11 + "end")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")
    began = time.time()
    got = {(r["doc_id"], r["item_id"]): (r["matched_words"], r["run_words"], r["doc_word"], r["item_word"]) for r in D.find_overlaps(d, t).collect()}
    assert got == {(0, 0): (3000, 3000, 0, 0), (1, 1): (2800, 2800, 0, 0), (2, 2): (20_000, 20_000, 1, 0), (3, 0): (12, 12, 0, 0)}
    assert time.time() - began < 60
    for a, b in ((np.arange(3000), np.arange(2000)), (np.arange(0, 9000, 7), np.arange(3, 2000, 7)), (np.array([5]), np.array([7]))):
        assert D.shifts(a, b).tolist() == sorted({int(x - y) for x in a for y in b})


def test_blocks_lose_nothing(spark, monkeypatch):
    rng = random.Random(2)
    long_item = [f"t{rng.randrange(10_000)}" for _ in range(9000)]
    tests = spark.createDataFrame([(1, " ".join(long_item)), (2, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id int, text string")
    docs = spark.createDataFrame([(i, " ".join(long_item[a : a + 30])) for i, a in enumerate((0, 3950, 4080, 8970))] + [(9, "zero one two three four five six seven eight nine ten eleven twelve thirteen")], "doc_id int, text string")
    monkeypatch.setattr(D, "BLOCK_WORDS", 2000)
    got = {(r["doc_id"], r["item_id"]): (r["matched_words"], r["item_word"]) for r in D.find_overlaps(docs, tests).collect()}
    assert got == {(0, 1): (30, 0), (1, 1): (30, 3950), (2, 1): (30, 4080), (3, 1): (30, 8970), (9, 2): (13, 0)}


def test_seeds_ignore_masked_positions():
    h, b = textkit.word_hashes(pa.array(["a b c d e f g h i j k", "a b c X e X X h i j k"]))
    x, y = h[b[0] : b[1]], h[b[1] : b[2]]
    assert (D.seeds(x, D.MASKS[0]) == D.seeds(y, D.MASKS[0]))[0]


URLS = {
    "https://A.Example.net/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
    "http://example.net/de/": ("example.net", "/de/", "net/", "block"),
    "http://notexample.com/de/x": ("notexample.com", "/de/x", None, None),
    "http://b.example.com/de/x?q=/en/": ("b.example.com", "/de/x", "example.com/de/", "block"),
    "http://x.org/fr/#a": ("x.org", "/fr/", "org/fr/", "allow"),
    "http://x.org?fr/": ("x.org", "", None, None),
    "ftp://h/a://b": ("h", "/a://b", None, None),
    "no scheme": ("", "", None, None),
    None: ("", "", None, None),
    "": ("", "", None, None),
    "x://ÄB.org/Fr/": ("Äb.org", "/Fr/", None, None),
    "http://net": ("net", "", None, None),
}


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("token", F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r["page_id"]: r for r in U.judge_urls(df, labels).collect()}
    for i, (_, want) in enumerate(URLS.items()):
        got = (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"])
        assert got == (*want[:3], want[3] or "allow")
    assert U.judge_urls(df.limit(0), labels).count() == 0


def test_mined_rules_against_counting(spark):
    rng = random.Random(3)
    pages, labels = [], []
    for i in range(600):
        spam = rng.random() < 0.3
        host = f"{'spam-farm' if spam and rng.random() < 0.8 else rng.choice(['shop', 'news', 'blog'])}.site{rng.randrange(4)}.org"
        pages.append((i, f"http://{host}/{rng.choice(['a', 'b'])}/{i}"))
        if i % 2:
            labels.append((i, 0 if spam and rng.random() < 0.95 else 1, 0))
    p, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels + [(None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    out = {r["page_id"]: r for r in U.judge_urls(p, lab).collect()}
    for i, url in pages:
        assert (out[i]["verdict"] == "block") == ("spam-farm" in url)
    baskets = [({f"t{j}" for j in range(5) if rng.random() < 0.5}, rng.random() < 0.5) for _ in range(200)]
    df = spark.createDataFrame([(sorted(t), b) for t, b in baskets], "tokens array<string>, bad boolean")
    got = {tuple(r["tokens"]): r["confidence"] for r in U.mine_rules(df, min_confidence=0.55, min_lift=1.0).collect()}
    from itertools import combinations

    sure = {}
    for n in range(1, 6):
        for c in combinations([f"t{j}" for j in range(5)], n):
            hit = [b for t, b in baskets if set(c) <= t]
            base = sum(b for t, b in baskets if t) / sum(1 for t, _ in baskets if t)
            if sum(hit) >= 5 and sum(hit) / len(hit) >= max(0.55, base):
                sure[c] = sum(hit) / len(hit)
    want = {c: s for c, s in sure.items() if not any(set(o) < set(c) and sure[o] >= s for o in sure)}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_a_url_of_many_tokens_in_many_rows_makes_few_sets(spark):
    tokens = [f"part{i}" for i in range(24)]
    rows = [(tokens, True)] * 300 + [(["a", f"x{i}"], False) for i in range(300)]
    got = U.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert [(r["tokens"], r["confidence"]) for r in got] == [(["part0"], 1.0)]


def test_one_hot_place_long_urls_and_repeated_rows(spark):
    pages = [(i, "http://same.com/hot/") for i in range(400)] + [(1000 + i, f"http://a{i % 50}.com/free-casino-{i}/") for i in range(100)] + [(2000, "http://x.com/" + "very-long/" * 30_000)] * 2 + [(7, "http://same.com/hot/"), (None, "http://y.com/my_casino")]
    labels = [(1000 + i, 0, 0) for i in range(60)] + [(i, 1, 0) for i in range(200)]
    p, lab = spark.createDataFrame(pages, "page_id long, url string").withColumn("token", F.lit("clash")).withColumn("many", F.lit(1)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = U.judge_urls(p, lab).collect()
    assert len(out) == len(pages) and sum(r["page_id"] == 2000 for r in out) == 2 and sum(r["page_id"] == 7 for r in out) == 2
    assert all((r["verdict"] == "block") == ("casino" in r["path"]) for r in out)


def test_a_combination_of_many_tokens_is_no_less_a_rule(spark):
    five = [f"t{i}" for i in range(5)]
    rows = [(five, True)] * 30 + [([t for t in five if t != skip], False) for skip in five for _ in range(60)]
    got = U.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert [(r["tokens"], r["confidence"]) for r in got] == [(five, 1.0)]


def test_twins_among_bad_rows_that_differ_among_good_ones_are_no_twins(spark):
    pages = [(i, f"http://h{i}.com/casino/{i}") for i in range(20)] + [(100 + i, f"http://g{i}.com/news/{i}") for i in range(200)] + [(900, "http://new.com/casino/"), (901, "http://new.com/news/")]
    labels = [(i, 0, 0) for i in range(20)] + [(100 + i, 1, 0) for i in range(200)]
    out = {r["page_id"]: r for r in U.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert (out[900]["verdict"], out[900]["mined_confidence"]) == ("block", 1.0) and out[901]["verdict"] == "allow"
    assert all(out[i]["verdict"] == "block" for i in range(20)) and all(out[100 + i]["verdict"] == "allow" for i in range(200))
