"""Quality of a text by its nearest labelled neighbours (operator 7).

Documents become TF-IDF vectors over hashed character n-grams, n-grams of character kinds
and words that repeat; latent semantic analysis of a bounded labelled sample turns them
into vectors of a few dozen numbers. The labelled vectors are sent to every executor, the
exact cosines of a block of documents with all of them are one matrix product, and the
nearest ones vote with weights that grow with their similarity.

Document frequencies cover all documents; only the labelled sample is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm import textkit
from freshet.llm.chargrams import codepoints, grams, pieces, text_parts
from freshet.llm.language_id import held_out

TEXT_BITS, KIND_BITS = 12, 12
WIDTH = (1 << TEXT_BITS) + (1 << KIND_BITS) + 8
DIMENSIONS = 48
NEIGHBOURS = 15


def _kinds(points: np.ndarray) -> np.ndarray:
    """Lower-case letters, capitals, digits and other letters each as one; other characters as they are."""
    out = points.copy()
    out[(points >= 97) & (points <= 122)] = 97
    out[(points >= 65) & (points <= 90)] = 65
    out[(points >= 48) & (points <= 57)] = 48
    high = points > 191
    if high.any():
        some = points[high]
        chars, back = np.unique(some, return_inverse=True)
        out[high] = np.array([65 if chr(c).isupper() else 97 if chr(c).isalpha() else c for c in chars], np.uint32)[back]
    return out


def term_counts(texts: list[str]) -> np.ndarray:
    """Counts of terms, a row for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for first, part, starts in pieces(texts):
        points, bound = codepoints(part)
        kinds = _kinds(points)
        spots = np.repeat(bound[:-1] - np.concatenate(([0], np.cumsum(starts)[:-1])), starts) + np.arange(starts.sum())
        owner = np.repeat(np.arange(len(part), dtype=np.int64) * WIDTH, starts)
        flat = np.zeros(len(part) * WIDTH, np.int64)
        for source, n, bits, base in ((points, 3, TEXT_BITS, 0), (kinds, 2, KIND_BITS, 1 << TEXT_BITS), (kinds, 4, KIND_BITS, 1 << TEXT_BITS)):
            g = grams(source, n, bits)
            m = spots < len(g)
            flat += np.bincount(owner[m] + base + g[spots[m]], minlength=len(flat))
        out[first : first + len(part)] += flat.reshape(len(part), WIDTH)
    words, wb = textkit.word_hashes(pa.array(texts, pa.string()))
    for back in (1, 2):  # a word again at once, or after one other
        same = np.zeros(len(words), np.int64)
        same[back:] = words[back:] == words[:-back]
        for i in range(len(texts)):
            run = int(same[wb[i] + back : wb[i + 1]].sum())
            share = run / max(1, wb[i + 1] - wb[i])
            out[i, WIDTH - 8 + back] = 60 * share  # of all words, whatever the length
    return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        for _, texts in text_parts(batch, 0, 1 << 19):
            for lo in range(0, len(texts), 256):
                some = term_counts(texts[lo : lo + 256])
                total += (some > 0).sum(axis=0)
            docs += len(texts)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(total[seen], docs), pa.int64())], ["term", "df"])


@dataclass
class QualityModel:
    """IDF, the latent basis, and the labelled vectors with their labels and weights."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def latent(self, texts: list[str]) -> np.ndarray:
        return latent(weighted(term_counts(texts), self.idf), self.basis)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Weighted share of label 1 among the nearest labelled vectors."""
        near = self.latent(texts) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.tile(np.arange(k), (len(texts), 1))
        sim = np.take_along_axis(near, top, axis=1).astype(np.float64)
        weight = np.maximum(sim, 1e-3) ** 8
        return (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.log1p(counts) * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def latent(rows: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = rows @ basis
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def latent_basis(rows: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The leading right singular vectors of `rows`, from the Gram matrix of the sample."""
    values, left = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    best = np.argsort(-values)[: min(dimensions, len(values))]
    best = best[values[best] > 1e-9 * max(values.max(), 1e-12)]
    return (rows.T @ (left[:, best] / np.sqrt(values[best]))).astype(np.float32)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in text_parts(batch, 1, 1 << 19):
            for lo in range(0, len(texts), 256):
                counts = term_counts(texts[lo : lo + 256])
                some = [np.flatnonzero(c) for c in counts]
                values = [c[s] for c, s in zip(counts, some, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, 256), pa.array(some, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["label", "terms", "counts"])


def fit_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", key_rule=None, per_label: int = 900) -> QualityModel | None:
    """Learns from labelled rows; None if there is none.

    Of each label (0 and 1) about `per_label` rows are used (all, where there are fewer),
    chosen by a hash of the id; `key_rule` is a condition on ids that may be learned from.
    Several labels of one id count as the highest; of several rows of one id the least text
    is learned from.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    given = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    if key_rule is not None:
        given = given.where(key_rule(F.col("id")))
    given = given.groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    if not sizes:
        return None
    draw = F.xxhash64(F.col("id").cast("string"), F.lit("quality sample"))
    chosen = F.lit(False)
    for label, size in sizes.items():
        share = per_label / size
        chosen = chosen | ((F.col("label") == label) & (F.lit(True) if share >= 1 else draw < int(share * 2**64) - 2**63))
    sample = given.where(chosen)  # 2 * per_label rows or so, whatever the size of the tables
    found = own.select("text").where("text is not null").mapInArrow(_frequencies, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df, docs_seen = np.zeros(WIDTH), 0
    for r in found:
        if r["term"] < 0:
            docs_seen = r["df"]
        else:
            df[r["term"]] = r["df"]
    idf = (np.log((1 + docs_seen) / (1 + df)) + 1).astype(np.float32)
    # of rows that share an id one is learned from: no more rows than the sample has come back
    learned = own.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    rows = learned.select("label", "text").mapInArrow(_texts, "label int, terms array<int>, counts array<float>").toArrow()
    if not rows.num_rows:
        return None
    counts = np.zeros((rows.num_rows, WIDTH), np.float32)
    for i, (t, c) in enumerate(zip(rows["terms"], rows["counts"], strict=True)):
        if len(t):
            counts[i, t.values.to_numpy()] = c.values.to_numpy()
    answer = np.array(rows["label"].to_pylist(), np.float64)
    order = sorted(range(len(counts)), key=lambda i: (answer[i], counts[i].tobytes()))  # tasks may end in any order
    matrix = weighted(counts[order], idf)
    basis = latent_basis(matrix)
    return QualityModel(idf, basis, latent(matrix, basis), answer[order])


def _scorer(model: QualityModel | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_parts(batch, 1, 1 << 19):
                for lo in range(0, len(texts), 256):
                    some = texts[lo : lo + 256]
                    values = model.scores(some) if model else np.full(len(some), 0.5)
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, 256), pa.array(np.clip(values, 0, 1))], ["id", "score"])

    return score


def score_quality(docs: DataFrame, model: QualityModel | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, score, predicted) of every row of `docs`; null texts count as empty, and empty ones are scored like others.

    Without a model every score is 0.5. Equal texts get equal scores; ids may repeat or be
    null; other columns are ignored.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = own.mapInArrow(_scorer(model), f"id {own.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 5, part: int = 0) -> DataFrame:
    """(id, held_out, score, predicted): learns from the labels that are not held out and scores all documents."""
    model = fit_quality_model(docs, labels, id_col, text_col, key_rule=lambda key: ~held_out(key, parts, part))
    key: Column = F.col(f"`{id_col}`")
    return score_quality(docs, model, id_col, text_col).select(key, held_out(key, parts, part).alias("held_out"), "score", "predicted")
