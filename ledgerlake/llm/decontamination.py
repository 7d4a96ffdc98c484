"""Benchmark decontamination by SimHash fingerprints of item-sized windows, with DataFrame functions alone.

Words are runs of letters and digits in lower case; shingles are five words, repeats included (a text
of fewer words is one shingle). A window has as many words as a benchmark item and may start at any
word: of all starts those are taken whose window has enough shingles that some item of that length has
too. With fewer than `similarity` times the item's shingles in common the similarity is smaller, so none
that could count is passed over, whatever the order of the passage.

A window's fingerprint is looked up among those of the items with as many words, by Hamming blocks:
BLOCKS blocks share 64 bits, so fingerprints within RADIUS differ by at most RADIUS // BLOCKS = 2 bits in one
block. Each side has the values one bit from its own, so that values two bits apart meet in the middle
and the index has 10 or 11 rows a block instead of 46 or 56. What lies within RADIUS is then compared exactly: the weighted
Jaccard similarity of the shingles (sum of smaller counts over sum of larger counts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import spread_join, stored, table, text_of

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 7
#: A table of items' shingles or fingerprints is broadcast up to so many rows (of under 100 bytes each).
BROADCAST_ROWS = 400_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(words: Column, width: int) -> Column:
    """Where a shingle of `width` words starts."""
    last = F.size(words) - width
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))


def _grams(hashes: Column, width: int) -> Column:
    """A hash for each run of `width` word hashes."""
    return F.transform(_starts(hashes, width), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(width))))


def shingles_of(words: Column) -> Column:
    """All shingles as text, in order; fewer words than WIDTH make one."""
    whole = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.expr("cast(array() as array<string>)"))
    many = F.transform(_starts(words, WIDTH), lambda i: F.array_join(F.slice(words, i + 1, F.lit(WIDTH)), " "))
    return F.when(F.size(words) < WIDTH, whole).otherwise(many)


def with_fingerprint(df: DataFrame, shingles: str, fp: str) -> DataFrame:
    """df with a 64-bit SimHash: a bit is 1 if set in over half the XXH64 hashes of the shingles."""
    hashed = df.withColumn("__hashes", F.transform(shingles, lambda s: F.xxhash64(s)))
    ones = lambda b: F.aggregate("__hashes", F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int"))
    bit = lambda b: F.when(ones(b) * 2 > F.size("__hashes"), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return hashed.withColumn(fp, F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda x, b: x.bitwiseOR(bit(b)))).drop("__hashes")


def block_bounds(blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(shift, bits) of each block."""
    sizes = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    return [(sum(sizes[:k]), sizes[k]) for k in range(blocks)]


def near_masks(bits: int) -> list[int]:
    """Every number of `bits` bits of which one is set or none."""
    return [0, *(1 << b for b in range(bits))]


def _blocks(fp: Column) -> Column:
    """(block, value) for every value of a block of fp within one bit of its own."""
    own = lambda shift, bits: F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))
    near = lambda k, shift, bits: F.transform(F.array(*(F.lit(m).cast("long") for m in near_masks(bits))), lambda m: F.struct(F.lit(k).alias("block"), own(shift, bits).bitwiseXOR(m).alias("value")))
    return F.flatten(F.array(*(near(k, shift, bits) for k, (shift, bits) in enumerate(block_bounds()))))


def benchmark_index(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, index): item_id, n, words, shingles, fp of each different item; and (block, value, item_id, n, fp)
    for every block value within a bit of an item's."""
    words = items.select("item_id", words_of(text_of(items)).alias("words")).distinct().where(F.size("words") > 0)
    known = words.select("item_id", "words", F.size("words").alias("n"), shingles_of(F.col("words")).alias("shingles"))
    known = stored(with_fingerprint(known, "shingles", "fp"), "benchmark-items")
    return known, stored(known.select("item_id", "n", "fp", F.inline(_blocks(F.col("fp")))), "benchmark-index")


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def _window_starts(at: Column, n: Column, width: int, similarity: float) -> Column:
    """Starts of windows of n words with enough of the sorted places `at` where shingles of items are: so many
    places follow each other within a window that starts from the last one's reach to the first one."""
    need = F.ceil(F.lit(similarity) * (n - width + 1) - 1e-9).cast("int")
    last = F.size(at) - need
    reach = lambda i: F.get(at, i + need - 1) - n + width
    ranges = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(reach(i).alias("low"), F.get(at, i).alias("high"))), lambda x: x["low"] <= x["high"])
    starts = F.array_distinct(F.flatten(F.transform(ranges, lambda x: F.sequence(x["low"], x["high"]))))
    return F.when(last >= 0, starts).otherwise(F.expr("cast(array() as array<int>)"))


def _lined_up(docs: DataFrame, known: DataFrame, most: int, similarity: float) -> DataFrame | None:
    """(doc_id, words, windows) of the documents that may hold an item: windows are (start, n)."""
    rows = docs.select("doc_id", text_of(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    widths = sorted(r[0] for r in known.select(F.least("n", F.lit(WIDTH))).distinct().collect())  # five numbers at most
    found = None
    for width in widths:
        mine = known.where(F.least("n", F.lit(WIDTH)) == width)
        marks = mine.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))).select("n", F.explode(_grams(F.col("hashes"), width)).alias("mark")).distinct()
        marks = stored(marks, "benchmark-shingles")
        hashed = rows.withColumn("words", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)))
        grams = hashed.select("doc_id", "h", F.posexplode(_grams(F.col("words"), width)))
        by_mark = marks.groupBy("mark").agg(F.collect_set("n").alias("ns"))  # no more than the items have lengths
        if by_mark.count() <= most:
            met = grams.join(F.broadcast(by_mark), F.col("col") == F.col("mark"))
        else:  # a frequent shingle is dealt out over salts
            met = spread_join(grams.withColumnRenamed("col", "mark"), by_mark, ["mark"], F.xxhash64("h", "pos"))
        hits = met.withColumn("n", F.explode("ns"))
        placed = hits.groupBy("doc_id", "h", "n").agg(F.array_sort(F.collect_set("pos")).alias("at"))
        placed = placed.select("doc_id", "h", "n", _window_starts(F.col("at"), F.col("n"), width, similarity).alias("starts")).where(F.size("starts") > 0)
        got = placed.select("doc_id", "h", F.expr("transform(starts, s -> struct(s as start, n as n))").alias("windows"))
        found = got if found is None else found.unionByName(got)
    if found is None:
        return None
    found = stored(found.select(F.col("doc_id").alias("k"), F.col("h").alias("kh"), "windows"), "benchmark-hits")
    same = lambda k, kh: (F.col("h") == F.col(kh)) & F.col("doc_id").eqNullSafe(F.col(k))
    keys = _small(found.select(F.col("k").alias("s"), F.col("kh").alias("sh")).distinct(), most)
    texts = rows.join(keys, same("s", "sh"), "left_semi").distinct()  # the rest of the texts isn't moved
    texts = texts.join(found, same("k", "kh"))
    return texts.select("doc_id", words_of(F.col("text")).alias("words"), "windows")


def contamination(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, most: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): a row for each document and item of which the
    document has a window with at least the given similarity. start counts words from 0 and is that of
    the most similar window, the first if several are.

    Null and empty texts match nothing, nor do items without words. Repeated rows give one row; so do
    documents that share a doc_id. A null doc_id or item_id is carried along. Empty tables give an empty
    result. Columns other than doc_id, item_id and text are ignored.
    """
    known, index = benchmark_index(items)
    lined = _lined_up(docs, known, most, similarity)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if lined is None:
        lined = docs.sparkSession.createDataFrame([], f"doc_id {kind}, words array<string>, windows array<struct<start:int,n:int>>")
    windows = lined.select("doc_id", "words", F.explode("windows").alias("w"))
    first = F.greatest(F.col("w.start"), F.lit(0))
    stop = F.least(F.col("w.start") + F.col("w.n"), F.size("words"))
    windows = windows.select("doc_id", first.alias("start"), (stop - first).alias("w_words"), F.col("w.n").alias("w_item"), F.slice("words", first + 1, stop - first).alias("words")).distinct()
    windows = windows.select("doc_id", "start", "w_words", "w_item", shingles_of(F.col("words")).alias("w_shingles"))
    windows = stored(with_fingerprint(windows, "w_shingles", "w_fp"), "benchmark-windows")
    size = F.col("w_words")
    looked = windows.select("doc_id", "start", "w_words", "w_item", "w_fp", F.inline(_blocks(F.col("w_fp"))))
    looked = looked.withColumnsRenamed({"block": "w_block", "value": "w_value"})
    near = looked.join(
        _small(index, most),
        (F.col("w_block") == F.col("block")) & (F.col("w_value") == F.col("value")) & (F.col("w_item") == F.col("n")) & (F.bit_count(F.col("w_fp").bitwiseXOR(F.col("fp"))) <= RADIUS),
    )
    pairs = near.select(F.col("doc_id").alias("p_doc"), F.col("start").alias("p_start"), size.alias("p_words"), F.col("w_fp").alias("p_fp"), F.col("item_id").alias("p_item"), F.col("n").alias("p_n"), F.col("fp").alias("p_item_fp")).distinct()
    pairs = pairs.join(windows, F.expr("p_doc <=> doc_id and p_start = start and p_words = w_words and p_n = w_item and p_fp = w_fp"))
    pairs = pairs.join(known, F.expr("p_item <=> item_id and p_n = n and p_item_fp = fp"))
    count = lambda a, k: F.size(F.filter(a, lambda x: x == k))
    shared = F.aggregate(F.array_intersect("w_shingles", "shingles"), F.lit(0), lambda s, k: s + F.least(count(F.col("w_shingles"), k), count(F.col("shingles"), k)))
    judged = pairs.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("w_shingles") + F.size("shingles") - F.col("shared")))
    best = F.max_by(F.struct("similarity", "start", "w_words"), F.struct("similarity", -F.col("start"), "w_words")).alias("best")
    found = judged.where(F.col("similarity") >= similarity).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "best.similarity", "best.start", F.col("best.w_words").alias("n_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs without a window that is like a benchmark item; all columns stay, whatever their names.

    Each row is judged by its own text, whatever its doc_id: a row without one goes if it holds an item, and one that shares it with such a
    row stays if it doesn't. Equal texts go together. Null and empty texts stay; texts are searched whole, however long.
    Without items every row stays, and an empty table stays empty."""
    digest = F.unhex(F.md5(text_of(docs).cast("binary")))
    texts = docs.select(digest.alias("doc_id"), text_of(docs).alias("text"))
    gone = contamination(texts, items).select(F.col("doc_id").alias("__gone")).distinct()
    gone = _small(stored(gone, "contaminated"), BROADCAST_ROWS)
    return docs.join(gone, digest == F.col("__gone"), "left_anti")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
