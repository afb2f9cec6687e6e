import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from freshet.functions import code, pii, text
from freshet.sources.match import PatternMatcher, expand_braces


def parts(splitter, t, **o):
    return [c["text"] for c in splitter.split(t, **o)]


def test_separators():
    s = text.SeparatorSplitter
    assert parts(s((r"\n\n+",)), " a \n\n\nb\n\n") == ["a", "b"]
    assert parts(s((r"\n\n+",), include_empty=True), "a\n\nb\n\n") == ["a", "b", ""]
    assert parts(s((r",",), "left", trim=False), "a,b,c") == ["a,", "b,", "c"]
    assert parts(s((r",",), "right", trim=False), "a,b,c") == ["a", ",b", ",c"]
    assert parts(s(()), " whole ") == ["whole"]
    assert parts(s((r"^#",)), "#a\n#b") == ["a", "b"]
    at = s((r"\n",)).split("é\n b")[1]
    assert at["start"] == {"byte_offset": 4, "char_offset": 3, "line": 2, "column": 2}
    assert parts(s((r",",)), "\u00a0a\u00a0,b") == ["\u00a0a\u00a0", "b"]  # only ASCII white space goes


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é.,;\n!", max_size=300), st.integers(5, 60), st.integers(0, 30))
def test_chunks_cover_the_text(t, size, overlap):
    chunks = text.RecursiveSplitter().split(t, size, chunk_overlap=overlap)
    seen = set()
    for c in chunks:
        a, b = c["start"]["char_offset"], c["end"]["char_offset"]
        assert t[a:b] == c["text"] and (len(c["text"].encode()) <= size or not re.search(r"\s", c["text"].strip()))
        seen.update(range(a, b))
    assert all(i in seen or not (c.isalnum()) for i, c in enumerate(t))
    starts = [c["start"]["char_offset"] for c in chunks]
    assert starts == sorted(starts)


def test_a_line_begins_with_blanks_not_with_separators():
    assert parts(text.RecursiveSplitter(), "\n; ;;é", chunk_size=5, chunk_overlap=0) == [" ;;é"]
    assert parts(text.RecursiveSplitter(), "a.\n\n  b.", chunk_size=3, chunk_overlap=0) == ["a.", "  b."]


def cheapest(atoms, largest, smallest, overlap):
    """The definition: every first atom of a chunk and every plan before it, in turn; the shortest of the cheapest."""
    n = len(atoms.start)
    edge = [(0, 2), *zip(atoms.cut[1:], atoms.lines[1:], strict=True), (0, 2)]
    plans = [(0, 0, 0)]
    for i in range(1, n + 1):
        best = None
        for s in range(i - 1, -1, -1):
            size = atoms.last[i - 1] - atoms.first[s]
            if s < i - 1 and size > largest:
                break
            cut = min([atoms.depth[i - 1], *[c for c, _ in edge[s + 1 : i]]])
            lines = max([*[x for _, x in edge[s + 1 : i]], *atoms.inner[s:i]])
            own = sum(sum(512 // k for k in range(1, c - cut + 1)) + 64 * max(0, lines - x) for c, x in (edge[s], edge[i])) + (size < smallest) * (1 << 20)
            for p in range(s, i):
                shared = atoms.last[p - 1] - atoms.first[s] if p > s else 0
                if shared > overlap or (p > s and (not overlap or s == 0 or plans[p][1] >= s)):
                    continue
                total = own if s == 0 else own + plans[p][0] + (512 - shared * 512 // overlap if overlap else 256)
                if best is None or total < best[0]:
                    best = (total, s, p)
        plans.append(best)
    spans, i = [], n
    while i:
        spans.append((atoms.start[plans[i][1]], atoms.end[i - 1]))
        i = plans[i][2]
    return spans[::-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é.,;\n!", max_size=200), min_size=1, max_size=6), st.integers(5, 60), st.integers(0, 30))
def test_texts_joined_together_have_the_cheapest_chunks(texts, size, overlap):
    splitter = text.RecursiveSplitter()
    patterns = [re.compile(s) for s in text.DEFAULT_SEPARATORS]
    least = min(overlap, size // 2)
    for t, chunks in zip(texts, splitter.split_all(texts, size, chunk_overlap=overlap), strict=True):
        atoms = splitter._atoms(t, patterns, least or size // 2)
        want = cheapest(atoms, size, size // 2, least) if atoms.start else []
        assert [(c["start"]["char_offset"], c["end"]["char_offset"]) for c in chunks] == want


def test_paragraphs_come_before_words():
    t = "one two three four.\n\nfive six seven eight."
    assert parts(text.RecursiveSplitter(), t, chunk_size=25) == ["one two three four.", "five six seven eight."]
    own = text.RecursiveSplitter((text.CustomLanguageConfig("pipes", (r"\|",), ("p",)),))
    assert parts(own, "aaaa|bbbb|cccc", chunk_size=5, language="P") == ["aaaa", "bbbb", "cccc"]
    with pytest.raises(ValueError):
        text.RecursiveSplitter((text.CustomLanguageConfig("a", ()), text.CustomLanguageConfig("A", ())))


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None), (3, "")], "id int, text string")
    got = text.split_column(df, "id", "text", text.SeparatorSplitter((r"\n",))).orderBy("id", "ordinal").collect()
    assert [(r["id"], r["ordinal"], r["text"], r["start"]["line"]) for r in got] == [(1, 0, "a", 1), (1, 1, "b", 2)]
    assert [(r["start"], r["text"]) for r in text.split_lines(df, "id", "text").orderBy("start").collect()] == [(0, "a"), (2, "b")]


def test_chunk_coverage_splits_once_over_all_cores(spark, tmp_path, capsys):
    import duckdb

    from freshet.plans import catalog

    odd = ["", None, " ", "\t", "\u3000", "a", "\u4f60\u597d\u3002\u4e16\u754c\uff01" * 300, ". " * 500, "x" * 900, "a\n" + " " * 900 + "b c", "  " + "y" * 1000 + " z", "\u00e9 " * 900, "a\U0001f600b " * 400]
    tables = {"odd": list(enumerate(odd)), "same": [(1, "a b c " * 400)] * 3, "none": []}
    for name, rows in tables.items():
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        out = catalog.queries()["chunk_coverage"](spark, path)
        assert [tuple(r) for r in out.collect()] == con.execute(catalog.oracle_sql()["chunk_coverage"]).fetchall(), name
    catalog.queries()["chunk_coverage"](spark, path).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") == 1 and "Join" not in plan  # each text is split once, and meets its chunks without a shuffle
    one = spark.read.parquet(f"{tmp_path}/odd/documents.parquet").coalesce(1)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitter = text.RecursiveSplitter()
    assert text.split_rows(one, "text", splitter, chunk_size=80).rdd.getNumPartitions() == n == text.split_column(one, "doc_id", "text", splitter, chunk_size=80).rdd.getNumPartitions()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \u00e9\U0001f600.,;\n!", max_size=120), min_size=1, max_size=8), st.integers(5, 60))
def test_what_chunks_cover(spark, texts, size):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    found = text.split_rows(df, "t", text.RecursiveSplitter(), chunk_size=size)
    rows = {r["id"]: r for r in found.select("id", "chunks", text.covered(F.col("t"), F.col("chunks")).alias("pieces")).collect()}
    for i, t in enumerate(texts):
        chunks, pieces, at = rows[i]["chunks"], rows[i]["pieces"], 0
        assert [c.asDict(True) for c in chunks] == text.RecursiveSplitter().split(t, size)
        assert all(p["inside"] for p in pieces) and len(pieces) == len(chunks) + 1
        for c, p in zip(chunks, pieces, strict=False):
            assert p["gap"] == t[at : c["start"]["char_offset"]]
            at = c["end"]["char_offset"]
        assert pieces[-1]["gap"] == t[at:]


def test_lost_words_and_wrong_offsets_are_seen(spark):
    def at(a, b, byte, words):
        place = lambda c, n: {"byte_offset": n, "char_offset": c, "line": 1, "column": c + 1}
        return {"text": words, "start": place(a, byte[0]), "end": place(b, byte[1])}

    good = [at(0, 2, (0, 3), "\u00e9a"), at(3, 4, (4, 5), "b"), at(6, 7, (7, 8), "d")]
    wrong = {"good": good, "lost": [good[0], good[2]], "char": [good[0], at(2, 3, (4, 5), "b"), good[2]], "byte": [good[0], at(3, 4, (3, 4), "b"), good[2]], "text": [good[0], at(3, 4, (4, 5), "c"), good[2]], "last": good[:2]}
    df = spark.createDataFrame([(k, "\u00e9a b, d", v) for k, v in wrong.items()], f"k string, t string, chunks {text.CHUNK}")
    pieces = df.select("k", text.covered(F.col("t"), F.col("chunks")).alias("p"))
    lost = F.exists("p", lambda x: x["gap"].rlike(f"[^{text.DROPPED}]"))
    got = {r["k"]: (r["inside"], r["lost"]) for r in pieces.select("k", F.forall("p", lambda x: x["inside"]).alias("inside"), lost.alias("lost")).collect()}
    assert got["good"] == (True, False) and got["lost"] == (True, True) and got["last"] == (True, True)
    assert not any(got[k][0] for k in ("char", "byte", "text"))


def test_shingles_compute_their_tokens_once(spark, capsys):
    df = spark.createDataFrame([(1, "one two three four"), (2, "one two"), (3, None)], "id int, t string")
    got = df.select("id", text.shingles(text.ascii_words(F.col("t")), 3).alias("s"))
    assert dict(got.collect()) == {1: ["one two three", "two three four"], 2: [], 3: []}
    got.explain(True)
    analyzed = capsys.readouterr().out.split("== Analyzed Logical Plan ==")[1].split("== Optimized")[0]
    assert analyzed.count("split(") == 1  # in a lambda it would be computed for each run
    long = spark.range(1).select(F.repeat(F.lit("word "), 20_000).alias("t"))
    assert long.select(F.size(text.shingles(text.ascii_words(F.col("t")), 3))).first()[0] == 19_998


def test_languages(spark):
    df = spark.createDataFrame([("main.py",), ("A.RS",), ("x.unknown",), ("Makefile",), ("a/b.c",)], "f string")
    assert [r[0] for r in df.select(text.detect_language(F.col("f"))).collect()] == ["python", "rust", None, None, "c"]


def test_matcher(spark):
    m = PatternMatcher(("*.py", "docs/**"), ("*test*", "!keep_test.py"))
    paths = {"a.py": True, "src/a.py": True, "src/test_a.py": False, "keep_test.py": True, "docs/x/y.md": True, "a.rs": False}
    assert {p: m.is_file_included(p) for p in paths} == paths
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"] for r in df.where(m.column(F.col("p"))).collect()} == {p for p, ok in paths.items() if ok}
    assert expand_braces("a{b,c{d,e}}") == ["ab", "acd", "ace"]
    d = PatternMatcher((), ("node_modules", "build*", "!build/keep/x.py"))
    assert not d.is_dir_included("node_modules") and d.is_dir_included("src") and d.is_dir_included("build")
    assert PatternMatcher(("**/x.py",)).is_file_included("x.py")


def test_personal_data(spark):
    t = "Mail a.b+c@mail.example.com, call (212) 555-0123 or 212-555-0199; SSN 123-45-6789, not 000-12-3456; card 4111 1111 1111 1111, not 4111 1111 1111 1112 nor 1111111111111111."
    df = spark.createDataFrame([(1, t), (2, None)], "id int, text string")
    n = df.select("id", *[c.alias(k) for k, c in pii.counts(F.col("text")).items()]).orderBy("id").collect()
    assert n[0].asDict() == {"id": 1, "email": 1, "phone": 2, "us_ssn": 1, "payment_card": 1} and n[1]["email"] == 0
    out = df.select(pii.redact(F.col("text")).alias("t")).first()["t"]
    assert out.count("[REDACTED_") == 5 and "4111 1111 1111 1112" in out and "000-12-3456" in out
    assert sorted(r["category"] for r in pii.findings(df, "id", "text").collect()) == ["email", "payment_card", "phone", "phone", "us_ssn"]
    go, aside = pii.enforce(df, "text", {"email": "quarantine", "us_ssn": "deny"})
    assert [r["pii_reason"] for r in aside.collect()] == ["deny:us_ssn"] and go.count() == 1


def test_code_patterns(spark):
    found = code.match_code(r"log(\A, \(REST*\))", "log(x, y, z(1, 2)); log(q)")
    assert [(m.text, m.bindings) for m in found] == [("log(x, y, z(1, 2))", {"A": "x", "REST": "y, z(1, 2)"})]
    assert [m.text for m in code.match_code(r"\X = \X", "a = b; c = c")] == ["c = c"]
    assert code.match_code(r"\(F:/get_\w+/\)(\_)", "set_a(1); get_b(2)")[0].bindings == {"F": "get_b"}
    assert code.match_code(r"if (\C) \{{ return \V \}}", "if (a) { x(); return 5; }")[0].bindings == {"C": "a", "V": "5"}
    assert not code.CodePattern("unlikely(\\_)").might_match("nothing here")
    df = spark.createDataFrame([(1, "foo(1)"), (2, "bar(1)"), (3, None)], "id int, src string")
    assert [(r["id"], r["bindings"]) for r in code.match_column(df, "id", "src", code.CodePattern(r"foo(\A)")).collect()] == [(1, {"A": "1"})]
    assert [e["name"] for e in code.python_elements("import os\nclass A:\n  def f(self):\n    g()\n")] == ["os", "A", "f", "g"]
    assert code.python_elements("def (") == []
    assert df.select(code.index_terms(F.col("src")).alias("t")).first()["t"] == ["foo"]


def test_decoding(spark):
    data = [(t.encode(e),) for t, e in (("é", "utf-8"), ("é", "utf-8-sig"), ("é", "utf-16"), ("é", "utf-32"))]
    df = spark.createDataFrame(data, "c binary")
    assert [r[0] for r in df.select(text.decode_bom(F.col("c"))).collect()] == ["é"] * 4


def test_personal_data_against_a_plain_search(spark):
    import re

    patterns = {"email": re.compile(pii.EMAIL.replace("(?iU)", ""), re.I), "phone": re.compile(pii.PHONE), "us_ssn": re.compile(pii.US_SSN), "payment_card": re.compile(pii.PAYMENT_CARD)}

    def luhn(candidate):
        digits = [int(c) for c in candidate if c.isdigit()]
        total = sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(digits)))
        return total % 10 == 0 and len(set(digits)) > 1

    def search(t):
        return {k: [m.group() for m in p.finditer(t) if k != "payment_card" or luhn(m.group())] for k, p in patterns.items()}

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text")
    edges = ["é@x.org a.b@c.de. _x@y.com- %z@q.io", "1-212-555-0123 (212) 555 0123 212.555.01234", "123 45-6789 900-11-1111 123-45-67890", "4111-1111-1111-1111 4111 1111 1111 1111 22", "", "@@ 12345"]
    every = docs.unionByName(spark.createDataFrame([(-1 - i, e) for i, e in enumerate(edges)], docs.schema))
    rows = every.select("doc_id", "text", *[pii.matches(F.col("text"), k).alias(k) for k in patterns], pii.redact(F.col("text")).alias("redacted")).collect()
    assert len(rows) > 200
    for r in rows:
        found = search(r["text"])
        assert {k: r[k] for k in patterns} == found
        assert sum(map(len, found.values())) > 0 or r["redacted"] == r["text"]
        assert all(r["redacted"].count(pii.REDACTED[k]) >= len(set(found[k])) for k in ("email", "us_ssn"))


def test_items_are_counted_within_their_row(spark):
    from collections import Counter

    texts = ["b a a c b a", "", None, "one", "x1 x1 y2 y2 z3", "zz " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in text.top_tokens(df, "id", "t", 2).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["token"], r["n"]))
    for i, t in enumerate(texts):
        want = sorted(Counter(w for w in (t or "").split() if len(w) > 1).items(), key=lambda c: (-c[1], c[0]))[:2]
        assert sorted(got.get(i, [])) == [(k + 1, w, n) for k, (w, n) in enumerate(want)]


def test_known_languages_are_cut_where_their_parts_begin():
    cut = lambda source, language, size: [c["text"] for c in text.RecursiveSplitter().split(source, size, min_chunk_size=10, language=language)]
    python = "import os\n\ndef first(a):\n    x = a\n\n    return x + 1\n\nclass Second:\n    y = 2\n\n    def third(self):\n        return 3\n"
    assert [c.split("(")[0].split(":")[0] for c in cut(python, "py", 60)] == ["import os", "def first", "class Second"] or cut(python, "py", 60)[1].startswith("class Second")
    rust = "fn one() {\n    let a = 1;\n\n    a\n}\n\nfn two() {\n    let b = 2;\n\n    b\n}\n"
    assert [c[:6] for c in cut(rust, "rust", 45)] == ["fn one", "fn two"]
    notes = "# A\n\nsome text\n\nmore text\n\n# B\n\nother text\n"
    assert [c[:3] for c in cut(notes, "markdown", 32)] == ["# A", "# B"]
    assert cut("a b\n\nc d", "unheard of", 100) == ["a b\n\nc d"]
    for language in text.LANGUAGE_SEPARATORS:
        assert "".join(cut(python, language, 40)).replace(" ", "").replace("\n", "") == python.replace(" ", "").replace("\n", "") or language == "x"
