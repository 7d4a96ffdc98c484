"""Quality probability by a byte-level convolutional network in numpy.

Every byte has a learned vector. Filters of WIDTH bytes are applied every STRIDE bytes over the whole
text, so that chunks overlap; each filter's largest answer anywhere in the text is kept, and those
maxima go through one hidden layer into a probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_sample, crc_mod, over_batches, table, text_of

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 16, 8, 8, 24, 12
TRAIN_ROWS = 1500  # labelled rows that the network learns from, at most
CUT = 0.3
BLOCK = 1 << 17  # bytes whose chunks are in memory at a time; a multiple of STRIDE


class ByteNet:
    """Weights as float32 arrays; deterministic for the same rows."""

    def __init__(self, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "e": f(256, EMBED, scale=0.5),
            "w": f(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5),
            "c": np.zeros(FILTERS, np.float32),
            "u": f(FILTERS, HIDDEN, scale=FILTERS**-0.5),
            "d": np.zeros(HIDDEN, np.float32),
            "v": f(HIDDEN, scale=HIDDEN**-0.5),
            "b": np.zeros(1, np.float32),
        }

    def pooled(self, data: bytes, where: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's maximum over all chunks, and at which byte that chunk starts. Zero bytes fill the last chunk."""
        n = max(1, -(-max(0, len(data) - WIDTH) // STRIDE) + 1)
        b = np.zeros((n - 1) * STRIDE + WIDTH, np.uint8)
        b[: len(data)] = np.frombuffer(data, np.uint8)
        best, spot = np.full(FILTERS, -np.inf, np.float32), np.zeros(FILTERS, np.int64)
        for at in range(0, n * STRIDE, BLOCK):
            x = self.p["e"][b[at : at + BLOCK + WIDTH - STRIDE]].reshape(-1)
            k = (len(x) // EMBED - WIDTH) // STRIDE + 1
            chunks = np.lib.stride_tricks.as_strided(x, (k, WIDTH * EMBED), (STRIDE * EMBED * 4, 4))
            y = chunks @ self.p["w"]
            top = y.max(axis=0)
            if where:
                spot = np.where(top > best, y.argmax(axis=0) * STRIDE + at, spot)
            best = np.maximum(best, top)
        return best + self.p["c"], spot

    def head(self, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.maximum(pool, 0)
        h = np.maximum(a @ self.p["u"] + self.p["d"], 0)
        return a, h, 1 / (1 + np.exp(-(h @ self.p["v"] + self.p["b"][0])))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return self.head(np.stack([self.pooled(t)[0] for t in texts]))[2] if texts else np.zeros(0)

    def fit(self, texts: list[bytes], y: np.ndarray, epochs: int = 14, batch: int = 24, rate: float = 4e-3) -> ByteNet:
        """Adam on the mean cross-entropy, in a fixed order. Gradients reach only the chunks that won a maximum."""
        if not texts:
            return self
        r = np.random.default_rng(2)
        m = {k: np.zeros_like(x) for k, x in self.p.items()}
        s = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            for at in np.array_split(r.permutation(len(texts)), max(1, -(-len(texts) // batch))):
                got = [self.pooled(texts[i], True) for i in at]
                pool = np.stack([x[0] for x in got])
                a, h, q = self.head(pool)
                g = {k: np.zeros_like(x) for k, x in self.p.items()}
                dz = ((q - y[at]) / len(at)).astype(np.float32)
                g["v"], g["b"][0] = h.T @ dz, dz.sum()
                dh = np.outer(dz, self.p["v"]) * (h > 0)
                g["u"], g["d"] = a.T @ dh, dh.sum(axis=0)
                da = (dh @ self.p["u"].T) * (pool > 0)
                g["c"] = da.sum(axis=0)
                for row, (_, spot) in enumerate(got):
                    data = np.frombuffer(texts[at[row]] + bytes(WIDTH), np.uint8)
                    won = np.minimum(spot[:, None] + np.arange(WIDTH), len(data) - 1)
                    sym = data[won]  # (filters, width)
                    g["w"] += (self.p["e"][sym].reshape(FILTERS, -1) * da[row][:, None]).T
                    np.add.at(g["e"], sym, (self.p["w"].T * da[row][:, None]).reshape(FILTERS, WIDTH, EMBED))
                step += 1
                lr = rate * min(1, 2 * (1 - step / (total + 1)))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, rows: int = TRAIN_ROWS) -> ByteNet:
    """A network from the whole texts of at most `rows` labelled documents, chosen by a hash of doc_id among
    the learnable ones; learnable is a condition on doc_id. Documents without label or text teach nothing; one
    labelled twice counts by its larger label, and one that is repeated is learned from once.

    The documents are chosen by id and label alone; only then are the chosen texts fetched."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    known = docs.where(learnable).select("doc_id").distinct().join(marks, "doc_id")
    chosen = bounded_sample(known, F.col("doc_id"), rows).select(F.col("doc_id").alias("__chosen"), "y")
    texts = docs.where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("__chosen"))
    got = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return ByteNet().fit([r["text"].encode("utf-8", "surrogatepass") for r in got], np.array([r["y"] for r in got], np.float32))


def quality_scores(docs: DataFrame, net: ByteNet) -> DataFrame:
    """(doc_id, score): the probability of good quality, one row per row of docs. Texts are scored
    whole, in blocks; null and empty texts get the score of one chunk of zero bytes. Columns other than
    doc_id and text are ignored."""

    def make(batch: pa.RecordBatch) -> dict:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "score": pa.array(net.scores(texts).astype(np.float64))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", text_of(docs).alias("text")), make, f"doc_id {kind}, score double")


def op1_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 5) == 0
    net = learn(docs, table(spark, sf_dir, "labels"), ~held)
    return quality_scores(docs, net).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
