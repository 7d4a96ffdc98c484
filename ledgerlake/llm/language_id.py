"""Language identification by the nearest of several centroids per language.

A text becomes a normalised TF-IDF vector of hashed byte trigrams; the language of the centroid with
the largest cosine is predicted, and a cosine below the language's own limit for texts of that length
rejects the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import BATCH_ROWS, crc_mod, over_batches, table, text_of

DIMS = 1 << 12
PER_LANGUAGE = 800  # training rows of a language, at most
CENTROIDS = 3
CUTS = tuple(1 << b for b in range(4, 13))  # characters to which training texts are cut for limits by length
QUANTILE = 0.005
#: Bytes that stand for letters keep their value, A-Z in lower case; the rest is one blank.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)).lower()


@dataclass
class Centroids:
    idf: np.ndarray
    matrix: np.ndarray  # (centroids, DIMS)
    langs: list[str]  # of each centroid
    limits: np.ndarray  # (centroids, CUTS): a smaller cosine is rejected

    def limit(self, best: np.ndarray, texts: list[str]) -> np.ndarray:
        """The limit of each text's centroid, from training texts cut to no more than the text's length."""
        cut = np.searchsorted(CUTS, [len(t) for t in texts], side="right") - 1
        return self.limits[best, np.maximum(cut, 0)]


def counts(text: str) -> np.ndarray:
    """Counts of hashed byte trigrams over the whole text, in lower case, with blanks at both ends."""
    total = np.zeros(DIMS, np.int64)
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b" "
    for at in range(0, len(data) - 2, 1 << 20):
        b = np.frombuffer(data[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)
        blank = np.uint32(32)
        total += np.bincount(h[~((b[1:-1] == blank) & (b[2:] == blank))], minlength=DIMS)
    return total


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.empty((len(texts), DIMS), np.float32)
    for k, t in enumerate(texts):
        x[k] = counts(t)
    x = np.log1p(x) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def nearest(texts: list[str], model: Centroids, rows: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(number, cosine) of each text's nearest centroid, `rows` texts at a time."""
    best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
    for at in range(0, len(texts), rows):
        cos = vectors(texts[at : at + rows], model.idf) @ model.matrix.T
        best[at : at + rows] = cos.argmax(axis=1)
        score[at : at + rows] = cos.max(axis=1)
    return best, score


def fit(texts: list[str], langs: list[str], per: int = CENTROIDS, slack: float = 0.75) -> Centroids:
    """Spherical k-means in each language, from a fixed seed. A limit is `slack` times the
    QUANTILE of the cosines of the language's own texts cut to a length, or of few texts the third smallest, so
    single odd rows don't set it; a length that under ten texts have takes the limit of the length before."""
    seen = np.zeros(DIMS, np.float64)
    for t in texts:
        seen += counts(t) > 0
    idf = (np.log((1 + len(texts)) / (1 + seen)) + 1).astype(np.float32)
    matrix, names, limits = [], [], []
    rng = np.random.default_rng(8)
    for lang in sorted(set(langs)):
        x = vectors([t for t, k in zip(texts, langs) if k == lang], idf)
        c = x[rng.permutation(len(x))[:per]]
        for _ in range(12):
            near = np.argmax(x @ c.T, axis=1)
            c = np.stack([x[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own, at = [t for t, k in zip(texts, langs) if k == lang], []
        for cut in CUTS:
            some = [t[:cut] for t in own if len(t) >= cut]
            if len(some) >= 10 or not at:
                best = (vectors(some or own, idf) @ c.T).max(axis=1)
                at.append(slack * float(np.quantile(best, min(1, max(QUANTILE, 2 / len(best))))))
            else:
                at.append(at[-1])
        matrix.append(c)
        names += [lang] * len(c)
        limits += [at] * len(c)
    return Centroids(idf, np.concatenate(matrix) if matrix else np.zeros((0, DIMS), np.float32), names, np.array(limits).reshape(-1, len(CUTS)))


def learn(docs: DataFrame, learnable: Column, per_language: int = PER_LANGUAGE) -> Centroids:
    """Centroids from at most `per_language` whole texts of each language, chosen by a hash of doc_id among the learnable rows.

    A language's rows are thinned by the hash to a little more than that before they are ranked, so no
    task gets the texts of a frequent language. The counts broadcast for it are as many as the model's languages.
    """
    rows = docs.where(learnable & F.col("lang").isNotNull()).select("doc_id", text_of(docs).alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rows = rows.join(F.broadcast(sizes), F.col("lang") == F.col("__lang")).where(place * F.col("__n") < 3 * per_language * (1 << 30))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    some = rows.select("lang", "doc_id", "text").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    got = some.orderBy("lang", "n").collect()
    return fit([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """(doc_id, lang_pred, score, rejected), one row per row of docs.

    score is the cosine with the nearest centroid, 0 to 1; equal cosines go to the language that sorts
    first. A null text or one without a letter gets `und`, 0 and rejected. Texts are read whole. Without
    centroids every text is `und`. Columns other than doc_id and text are ignored.
    """
    names = np.array(model.langs, dtype=object)

    def make(batch: pa.RecordBatch) -> dict:
        texts, n = batch.column(1).to_pylist(), batch.num_rows
        best, score = nearest(texts, model) if len(names) else (np.zeros(n, np.int64), np.zeros(n))
        limit = model.limit(best, texts) if len(names) else np.ones(n)
        return {"doc_id": batch.column(0), "lang_pred": pa.array(names[best] if len(names) else ["und"] * n, pa.string()), "score": np.clip(score, 0, 1), "rejected": score < limit, "letter": batch.column(2)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = text_of(docs)
    out = over_batches(docs.select("doc_id", text.alias("text"), text.rlike(r"\p{L}").alias("letter")), make, f"doc_id {kind}, lang_pred string, score double, rejected boolean, letter boolean")
    return out.select(
        "doc_id",
        F.when(F.col("letter"), F.col("lang_pred")).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(F.col("letter"), F.col("score")).otherwise(F.lit(0.0)).alias("score"),
        (~F.col("letter") | F.col("rejected")).alias("rejected"),
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, with all columns, by centroids learned from the same rows.

    Null and empty texts and those without a letter go. Texts are judged whole, however long. Rows that are
    repeated or share a doc_id are judged each by its text, so equal texts stay or go together; a row
    without doc_id or lang is judged like any other. An empty table, and one without a lang to learn from,
    gives an empty result. Other columns, whatever their names, are carried along.
    """
    model = learn(docs, crc_mod(F.col("doc_id"), 4) != 2)
    spot = docs.columns.index("text")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                keep = np.zeros(batch.num_rows, bool)
                letter = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
                texts = [t or "" for t in batch.column(spot).to_pylist()]
                if model.langs:
                    best, cos = nearest(texts, model)
                    keep = cos >= model.limit(best, texts)
                yield batch.select(list(range(batch.num_columns - 1))).filter(pa.array(keep & letter))

    marked = docs.withColumn("__letter", F.coalesce(docs["text"].rlike(r"\p{L}"), F.lit(False)))
    return marked.mapInArrow(run, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    found = identify(docs, learn(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
