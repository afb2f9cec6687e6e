"""Language of a text (operator 4).

Sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams,
trained by follow-the-regularised-leader with L1 and L2 penalties, then calibrated by a
temperature. Document frequencies come from all labelled rows; the weights are fitted on a
bounded sample of them on the driver and sent to the executors (a table of fixed size).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.chargrams import codepoints, grams, pieces, text_parts
from freshet.llm.textkit import tidy

BITS = 15
SIZES = (1, 2, 3)
_SCALE = 20.0


def _spots(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    points, bound = codepoints(texts)
    return [grams(points, n, BITS) for n in SIZES], bound


def _counts(text: str) -> np.ndarray:
    """Numbers of a text's n-grams by bucket."""
    count = np.zeros(1 << BITS, np.int64)
    for _, part, starts in pieces([text.lower()]):
        for s in _spots(part)[0]:
            count += np.bincount(s[: starts[0]], minlength=1 << BITS)
    return count


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        for _, texts in text_parts(batch, 0):
            now, seen = -1, np.zeros(1 << BITS, bool)
            for first, part, starts in pieces([t.lower() for t in texts]):
                spots, bound = _spots(part)
                for i in range(len(part)):
                    if first + i != now:
                        total += seen
                        now, seen = first + i, np.zeros(1 << BITS, bool)
                    for s in spots:
                        seen[s[bound[i] : bound[i] + starts[i]]] = True
            total += seen
            docs += len(texts)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], docs), pa.int64())], ["bucket", "df"])


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_parts(batch, 1):
            buckets, counts = [], []
            for text in texts:
                count = _counts(text)
                some = np.flatnonzero(count)
                buckets.append(some.astype(np.int32))
                counts.append(count[some].astype(np.float32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(buckets, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["label", "buckets", "counts"])


@dataclass
class LanguageModel:
    """Weights by bucket and language (IDF multiplied in), IDF, bias, languages and temperature."""

    languages: list[str]
    weights: np.ndarray
    idf: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        k = len(self.languages)
        wide = np.ascontiguousarray(np.concatenate((self.weights, self.idf[:, None]), axis=1).astype(np.float32))
        total = np.zeros((len(texts), k + 1), np.float64)
        for first, part, starts in pieces([t.lower() for t in texts]):
            spots, bound = _spots(part)
            inside = np.zeros(int(bound[-1]), bool)  # an n-gram that begins in a gap is none
            inside[np.repeat(bound[:-1] - np.concatenate(([0], np.cumsum(starts)[:-1])), starts) + np.arange(starts.sum())] = True
            for s in spots:
                some = np.flatnonzero(inside[: len(s)])
                owner = np.searchsorted(some, bound[:-1])
                full = np.flatnonzero(np.diff(np.append(owner, len(some))))
                if len(full):
                    total[first + full] += np.add.reduceat(wide[s[some]], owner[full], axis=0, dtype=np.float32)
        return _SCALE * total[:, :k] / np.maximum(total[:, k:], 1e-9) + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (bucket, class) and bias by per-coordinate FTRL-proximal updates over sparse rows (buckets, values)."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def solve(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, 1 << BITS), np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = solve(zi, ni)
            p = _softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    w = solve(z, n)
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows that no weight was fitted on."""
    grid = np.geomspace(0.05, 10, 120)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit_language_model(labelled: DataFrame, text: Column, label: Column, key: Column, per_class: int = 600, most_classes: int = 200) -> LanguageModel | None:
    """Learns from rows with a label; None if there is none.

    Document frequencies cover all labelled rows. The weights are fitted on a sample of about
    `per_class` rows of each language (all, where there are fewer), chosen by a hash of `key`.
    More than `most_classes` languages are an error.
    """
    rows = labelled.select(text.cast("string").alias("text"), label.cast("string").alias("label"), F.xxhash64(key.cast("string"), F.lit("language sample")).alias("draw")).where("label is not null and text is not null")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().limit(most_classes + 1).collect()}
    if not sizes:
        return None
    if len(sizes) > most_classes:
        raise ValueError("too many languages")
    languages = sorted(sizes)
    found = rows.select("text").mapInArrow(tidy(_frequencies), "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df, docs = np.zeros(1 << BITS), 0
    for r in found:
        if r["bucket"] < 0:
            docs = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    idf = np.log((1 + docs) / (1 + df)) + 1
    draw = F.lit(False)
    for name in languages:
        share = per_class / sizes[name]
        draw = draw | ((F.col("label") == name) & (F.lit(True) if share >= 1 else F.col("draw") < int(share * 2**64) - 2**63))
    sample = rows.where(draw).select("label", "text").mapInArrow(_histogram, "label string, buckets array<int>, counts array<float>").toArrow()
    labels = np.array([languages.index(x) for x in sample["label"].to_pylist()], np.int64)
    data = []
    for b, c in zip(sample["buckets"], sample["counts"], strict=True):
        at = b.values.to_numpy() if b.values is not None else np.zeros(0, np.int32)
        x = c.values.to_numpy() * idf[at]
        data.append((at, _SCALE * x / max(x.sum(), 1e-9)))
    # in an order of their own, as tasks may end in any
    order = sorted(range(len(data)), key=lambda i: (labels[i], len(data[i][0]), data[i][1].tobytes()))
    held = set(order[::5]) if len(order) >= 50 else set()
    train = [i for i in order if i not in held]
    weights, bias = fit_ftrl([data[i] for i in train], labels[train], len(languages))
    check = sorted(held) if held else train
    logits = np.array([data[i][1] @ weights[data[i][0]] + bias for i in check])
    return LanguageModel(languages, weights * idf[:, None], idf, bias, _temperature(logits, labels[check]))


def _predictor(model: LanguageModel | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch, 1):
                letters = pc.fill_null(pc.match_substring_regex(part.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if model is None:
                    names, score = ["und"] * len(part), np.zeros(len(part))
                else:
                    p = _softmax(model.logits(texts) / model.temperature)
                    best = p.argmax(axis=1)
                    names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    return predict


def predict_language(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row of `docs`.

    lang_pred is `und` and score 0 for a null text, for one without a letter, and if there is
    no model; else score is the calibrated probability of lang_pred. Only the text is looked
    at: equal texts, equal values. Ids may repeat or be null; other columns are ignored.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = own.mapInArrow(tidy(_predictor(model)), f"id {own.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def _keeper(model: LanguageModel | None, column: str, accepted: set[str] | None, min_score: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictor(model)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(column))
            mine = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), text], ["id", "text"])
            for out in predict(iter([mine])):
                good = [n != "und" and (accepted is None or n in accepted) and s >= min_score for n, s in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True)]
                yield batch.take(pc.filter(out.column(0), pa.array(good, pa.bool_())))

    return keep


def keep_languages(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", accepted: set[str] | None = None, min_score: float = 0.4) -> DataFrame:
    """`docs`, all columns, without the rows whose language cannot be told (und, or a score below `min_score`) or is not accepted. No shuffle.

    Without a model nothing can be told, and no row stays.
    """
    return docs.mapInArrow(tidy(_keeper(model, text_col, accepted, min_score)), docs.schema)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == part


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", parts: int = 4, part: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score): learns from the rows that are not held out and predicts all."""
    key = F.col(f"`{id_col}`")
    model = fit_language_model(docs.where(~held_out(key, parts, part)), F.col(f"`{text_col}`"), F.col(f"`{label_col}`"), key)
    return predict_language(docs, model, id_col, text_col).select(key, held_out(key, parts, part).alias("held_out"), "lang_pred", "score")
