import random
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_stages_against_their_own_rules(spark, tmp_path):
    rng = random.Random(6)
    syllables = {"en": "the ing er on ly at".split(), "de": "sch ung ein ber te ü".split()}
    prose = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, prose(lang := rng.choice(["en", "de"]), rng.randint(20, 80)), lang, f"src{i % 3}") for i in range(150)]
    items = [(j, prose("en", 25)) for j in range(5)]
    rows += [(200 + i, rows[i][1], rows[i][2], "src0") for i in range(10)]  # copies
    rows += [(300 + j, f"{prose('en', 10)} {t} {prose('en', 10)}", "en", "src1") for j, t in items]  # leaks
    rows += [(400, None, None, "src1"), (401, "12 34", "en", None), (402, "", None, None)]
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {r[0]: r[1] for r in rows}
    kept = []
    assert [name for name, _ in corpus_pipeline.STAGES[2:4]] == ["decontamination", "poisson_mix"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == table.columns
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
        assert all(r["text"] == text[r["doc_id"]] for r in docs.collect())
    told, single, clean, mixed = kept
    assert told == sorted(i for i in text if i not in (400, 401, 402))
    assert single == [i for i in told if not 200 <= i < 210]
    assert clean == [i for i in single if i < 300]
    assert set(mixed) <= set(clean) and 0.5 * len(clean) < len(mixed) < 1.6 * len(clean)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted(r["doc_id"] for r in out) == mixed
    # token files are in the order of the mix
    from freshet.llm.mixing import mix

    before = spark.read.parquet(f"{tmp_path}/decontamination")
    in_mix = [r["doc_id"] for r in mix(before).orderBy("position").select("doc_id").collect()]
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])] == in_mix and in_mix != sorted(in_mix)
    for r in out:
        ids = [*tool.encode(text[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
    unfiled = spark.createDataFrame(docs.collect(), docs.schema)
    by_id = sorted(corpus_pipeline.STAGES[-1][1](spark, unfiled, str(tmp_path)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_id] == mixed
