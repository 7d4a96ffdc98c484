"""Token counts through a cache keyed by content and tokenizer digests.

Only distinct contents that the cache lacks are encoded; their counts are appended to it, and the
answer is the join of all rows with the cache.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import over_batches, shared_folder, spread_join, stored, table, text_of

MODEL = "byte_bpe_50k.json"
LIMIT = 512
PIECE = 1 << 15
SAFE = re.compile(r"(?<=[!-~])(?= )")
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"


def version(path: str) -> str:
    """Digest of the tokenizer's file, so that counts of another version never match."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=2)
def counter(path: str):
    """A function from a list of texts to their token counts, as the file's library gives them."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def count_texts(path: str, texts: list[str]) -> list[int]:
    """Counts of whole texts. With a byte-level model, long ones are counted in parts cut where no match of its pattern reaches across."""
    whole = os.path.basename(path).startswith("byte_bpe")
    parts, owner = [], []
    for k, t in enumerate(texts):
        at = 0
        while whole and len(t) - at > PIECE and (cut := SAFE.search(t, at + PIECE)):
            parts.append(t[at : cut.start()])
            owner.append(k)
            at = cut.start()
        parts.append(t[at:])
        owner.append(k)
    counts = [0] * len(texts)
    for k, n in zip(owner, counter(path)(parts)):
        counts[k] += n
    return counts


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an absent cache is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache) if there else spark.createDataFrame([], CACHE_SCHEMA)


def add_missing(docs: DataFrame, path: str, cache: str) -> None:
    """Encodes the distinct contents of docs (text) that the cache lacks, and appends their counts.

    Copies are gathered within each task before anything moves, so a content that very many rows have
    reaches its task once from each of the others. The join with the cache keeps that partitioning."""
    spark, key = docs.sparkSession, version(path)
    text = text_of(docs)
    keyed = docs.select(F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
    known = read_cache(spark, cache).where(F.col("tokenizer") == key).select("digest").distinct()
    missing = keyed.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")

    def make(batch: pa.RecordBatch) -> dict:
        return {"tokenizer": [key] * batch.num_rows, "digest": batch.column(0), "n_tokens": pa.array(count_texts(path, batch.column(1).to_pylist()), pa.int64())}

    over_batches(missing, make, CACHE_SCHEMA).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row per row of docs.

    A null text counts as empty. Contents are equal if their UTF-8 bytes are; a null is made empty and
    nothing else is changed, since any other normalising could change a count. A cache that holds a
    count twice, as after a repeated append, is read once. Columns other than doc_id and text are ignored.
    """
    add_missing(docs, path, cache)
    text = text_of(docs)
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("digest"))
    rows = stored(rows, "digests")
    known = read_cache(docs.sparkSession, cache).where(F.col("tokenizer") == version(path)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return spread_join(rows, known, ["digest"], F.col("doc_id")).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded in the call."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), shared_folder(spark, "token-cache"))
