"""A corpus pipeline: documents pass five operators, each on what the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlake.llm.bpe import RANKS, encoded
from ledgerlake.llm.common import discard, scratch, shared_folder, table
from ledgerlake.llm.decontamination import drop_contaminated
from ledgerlake.llm.language_id import keep_identified
from ledgerlake.llm.simhash_dedup import drop_near_duplicates
from ledgerlake.llm.suffix_dedup import without_repeats

#: Bytes of a string that may not repeat: passages of over fifty words are longer.
REPEAT = 200


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those of no language learned here, and null, empty and blank
    texts. All columns stay. Texts are judged whole, each row by its own; equal rows stay or go together. An empty
    table, or one without lang to learn from, gives an empty result."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, with all its columns: that with the smallest doc_id, nulls
    last, of repeated rows one. Null, empty and blank texts are one group. An empty table gives an empty result."""
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of REPEAT bytes and more that occur more than once are cut out everywhere; all rows and columns
    stay, null and short texts as they are. Repeated rows are documents of their own. An empty table stays empty."""
    return without_repeats(docs, REPEAT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. All columns stay, and so do null and empty texts, rows without
    doc_id, and, where there are no items, every row."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row: the token ids of the whole text and digests of
    them and of what they decode to. The last stage returns these alone; other columns are not carried on. A null text
    counts as empty and has no tokens; an empty table gives an empty result."""
    found = encoded(docs, public_tokenizers.path(RANKS), with_ids=False)
    return found.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


STAGES = [("language_id", identify), ("near_dedup", near_duplicates), ("suffix_dedup", repeats), ("decontamination", decontaminate), ("bpe", encode)]

#: SQL has no SimHash, suffix arrays or merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next. What a stage has stored on
    its way is deleted once its result is written, and that result once the next one is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        with scratch(spark):
            result = stage(spark, docs, sf_dir)
            result.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        discard(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
