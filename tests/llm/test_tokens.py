import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from freshet.llm import textkit, token_count, token_output  # noqa: E402
from freshet.llm.runtime import open_fs  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcAZ'sStTéÉİΣσςßǺ\u0308Kﬁ中😀\u200d 0123½²٣ \n\t\r\x0b\x0c\x1c\x85\u00a0\u2000\u3000#$<|>.,-_\u0000\ufeffẞ"
EDGES = ["DON'T. it's... É.. Ünï#, 12,. x<|endoftext|>. a.\u0301 b. \u0301", "<|ENDOFTEXT|>. J\u030c. A\u030a. ", "tail!?\n(a) [b]_ c'd. 'S. x'", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "a" * 3000, "aaa aaaa aaaaa", "x<|ENDOFTEXT|>", "", "it's 'll'd'S'T", "ab" * 5000, "J\u030c", "\u0308x"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts(n=800, seed=2):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)] + EDGES


def test_counts_are_the_librarys(spark):
    ts = texts() + ["w " * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)] + [(-1, None), (None, "x y"), (0, ts[0])], "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = [(r["doc_id"], r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in token_count.token_counts(df, PATH).collect()]
    want = [(i, len(e.ids), len(ts[i].encode()), len(e.ids) > 2048) for i, e in enumerate(library().encode_batch(ts, add_special_tokens=False))]
    want += [(-1, 0, 0, False), (None, 2, 3, False), want[0]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert token_count.token_counts(df.limit(0), PATH).count() == 0


def test_all_code_points_are_as_the_library_has_them():
    points = [c for c in (*range(0x20000), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]
    tool, merger, encoder = library(), token_count.RankMerger(PATH), token_output.Encoder(PATH)
    for form in ("{0} a{0}B1", "information{0}information", "X{0}. é{0}## Z.{0} É{0}"):
        for lo in range(0, len(points), 40_000):
            ts = [form.format(chr(c)) for c in points[lo : lo + 40_000]]
            want = [e.ids for e in tool.encode_batch_fast(ts, add_special_tokens=False)]
            values, bound = encoder.ids(pa.array(ts))
            assert [values[a:b].tolist() for a, b in zip(bound, bound[1:], strict=False)] == want
            pieces, at, ends = token_count.pieces_of(pa.array(ts))
            total = np.concatenate(([0], np.cumsum(merger.piece_counts(pieces.to_pylist())[at])))
            assert (total[ends[1:]] - total[ends[:-1]]).tolist() == [len(w) for w in want]


def test_very_long_texts_and_clashing_columns(spark):
    ts = ["".join(f"w{i % 977}x{i} " for i in range(200_000)), "z" * 100_000, "a\u3000b\x0bc " * 20_000]
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 as id", "2 as part", "3 as n_tokens", "4 as file")
    want = [len(e.ids) for e in library().encode_batch(ts, add_special_tokens=False)]
    assert [r["n_tokens"] for r in token_count.token_counts(df, PATH).orderBy("doc_id").collect()] == want
    assert [r["n_tokens"] - 1 for r in token_output.token_output(df, PATH, 2).orderBy("doc_id").collect()] == want


def test_memory_of_words_may_start_anew(monkeypatch):
    monkeypatch.setattr(token_count, "KNOWN_WORDS", 3)
    tool = token_count.RankMerger(PATH)
    for _ in range(3):
        assert tool.piece_counts(["hello", "strange", "world", ""]).tolist() == [1, 1, 1, 0]
        assert tool.piece_counts(["other", "words", "hello", "four"]).tolist() == [1, 1, 1, 1]
    memory, asked = textkit.Memory(2), []
    for keys in (["a", "b", "c"], ["a", "d"], ["e", "a"], ["x" * 65], ["x" * 65], ["b"]):
        assert memory.values(keys, lambda fresh: (asked.append(fresh), [k.upper() for k in fresh])[1]) == [k.upper() for k in keys]
    assert asked[:5] == [["a", "b", "c"], ["d"], ["e"], ["x" * 65], ["x" * 65]]


def test_ids_are_the_librarys():
    ts = texts(seed=4)
    values, bound = token_output.Encoder(PATH).ids(pa.array(ts))
    for i, e in enumerate(library().encode_batch(ts, add_special_tokens=False)):
        assert values[bound[i] : bound[i + 1]].tolist() == e.ids


def test_whole_texts_where_white_space_counts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    values, bound = token_output.Encoder(path).ids(pa.array(["a  b\n", "", "c"]))
    for i, e in enumerate(Tokenizer.from_file(path).encode_batch(["a  b\n", "", "c"], add_special_tokens=False)):
        assert values[bound[i] : bound[i + 1]].tolist() == e.ids


def test_round_trip(spark, tmp_path):
    ts = texts(300, 6)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(ts)] + [(5000, None), (5001, "same"), (5001, "same")]
    out = token_output.token_output(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 2).collect()
    ids = {i: [*e.ids, 2] for (i, _), e in zip(rows, library().encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True)}
    start = 0
    for r in sorted(out, key=lambda r: r["start"]):
        own = ids[r["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)
    assert [r["doc_id"] for r in sorted(out, key=lambda r: r["start"])] == sorted(i for i, _ in rows)


def test_readers_open_what_they_want(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    folder = f"file://{tmp_path}/files"
    index = token_output.write_token_files(spark.createDataFrame([(i, f"word{i} again") for i in range(20)], "doc_id long, text string"), folder, PATH, 2, files=1).orderBy("id").collect()
    fs, root = open_fs(folder)
    name = f"{root}/{index[0]['file']}"
    reader = token_output.Reader(fs, name)
    want = [*library().encode("word7 again", add_special_tokens=False).ids, 2]
    assert reader.run(7, 8)[0].tolist() == want
    raw = bytearray(open(name, "rb").read())
    raw[index[7]["frame_at"] + index[7]["frame_bytes"] - 1] ^= 0xFF
    open(name, "wb").write(raw)
    damaged = token_output.Reader(fs, name)
    with pytest.raises(Exception):  # noqa: B017
        damaged.run(7, 8)
    assert damaged.run(8, 9)[0][-1] == 2
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_output.token_output(empty, PATH, 2).count() == 0
