"""Words that differ by one edit, found by range reporting in two dimensions, and the commoner form of each.

Words of one length have a rank in forward order and one in the order of their reversals. A wavelet tree over the
reverse ranks in forward order reports the words in a rectangle: those between a prefix's bounds and a
suffix's. For each edit position of a word the prefix before it and the suffix behind it give such a rectangle,
among words of its own length for a replaced code point, among those one longer for an inserted one; a deleted one
is the latter seen from the other side.

Words are dealt to trees by all but SEGMENT neighbouring code points, so both words of a pair meet wherever the edit lies, and
no key has more words than SEGMENT code points can spell: (26 + 64) ** 2. So no key is hot, whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import stored, table, text_of

# Fixed values of the contract: letters beyond A-Z, how often a run loses a code point, and what counts as a word and as its form.
LETTERS = "a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOISE, LEAST_LENGTH, LEAST_COUNT, TIMES = 199, 6, 5, 5

#: Neighbouring code points of which one may be edited, for one key.
SEGMENT = 2
#: Rows for one task's trees, on average.
SHARD = 150_000
#: Rectangles that are searched together.
TOGETHER = 1 << 16


class WaveletTree:
    """Over a permutation: bit by bit from the highest, each level keeps its zeros before its ones."""

    def __init__(self, ranks: np.ndarray) -> None:
        self.bits = max(1, int(len(ranks) - 1).bit_length()) if len(ranks) else 1
        self.ones: list[np.ndarray] = []
        level = ranks.astype(np.int64)
        for k in range(self.bits - 1, -1, -1):
            bit = (level >> k) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, rank): all ranks of [least, most) at the places [lo, hi), for each query."""
        q = np.flatnonzero((lo < hi) & (least < most))
        lo, hi, low = lo[q], hi[q], np.zeros(len(q), np.int64)
        for depth, ones in enumerate(self.ones):
            half = 1 << (self.bits - 1 - depth)
            n_zeros = len(ones) - 1 - ones[-1]
            one_lo, one_hi = ones[lo], ones[hi]
            parts = []
            for a, b, base in ((lo - one_lo, hi - one_hi, low), (n_zeros + one_lo, n_zeros + one_hi, low + half)):
                keep = (a < b) & (base < most[q]) & (base + half > least[q])
                parts.append((q[keep], a[keep], b[keep], base[keep]))
            q, lo, hi, low = (np.concatenate(x) for x in zip(*parts))
        return q, low


def _reversed(words: np.ndarray) -> np.ndarray:
    n = words.dtype.itemsize
    return np.ascontiguousarray(words.view(np.uint8).reshape(-1, n)[:, ::-1]).view(f"S{n}").ravel()


def _between(ordered: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds of the words that begin with each head; words are in order and all of one length."""
    n, k = ordered.dtype.itemsize, heads.shape[1]
    first, last = np.full((len(heads), n), 0, np.uint8), np.full((len(heads), n), 255, np.uint8)
    first[:, :k] = last[:, :k] = heads
    return np.searchsorted(ordered, first.view(f"S{n}").ravel(), "left"), np.searchsorted(ordered, last.view(f"S{n}").ravel(), "right")


def near_words(words: np.ndarray, asked: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): for each asked word the indices of the words that have a code point replaced or, if words are one longer, inserted
    at the position. words are different and of one length, in Latin-1; asked words are of their length or one shorter."""
    n, m = words.dtype.itemsize, asked.dtype.itemsize
    backward = _reversed(words)
    forward_order, backward_order = np.argsort(words), np.argsort(backward)
    forward, backward = words[forward_order], backward[backward_order]
    place = np.empty(len(words), np.int64)
    place[backward_order] = np.arange(len(words))
    tree = WaveletTree(place[forward_order])
    signs = asked.view(np.uint8).reshape(-1, m)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in np.unique(position).tolist():
        at = np.flatnonzero(position == i)
        for k in range(0, len(at), TOGETHER):
            some = at[k : k + TOGETHER]
            behind = i + 1 if m == n else i
            lo, hi = _between(forward, signs[some, :i])
            least, most = _between(backward, signs[some, behind:][:, ::-1])
            q, rank = tree.report(lo, hi, least, most)
            found.append((some[q], backward_order[rank]))
    return tuple(np.concatenate(x) for x in zip(*found))


def word_counts(docs: DataFrame, noise: int = NOISE, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of whole texts with at least so many code points and occurrences. Of a run whose h `noise` divides, a code point
    is deleted. A null text has no words and a null doc_id counts as empty text; repeated rows count each."""
    lower = F.translate(text_of(docs), UPPER, LOWER)
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), F.explode(F.split(lower, f"[^{LETTERS}]+")).alias("run")).where(F.length("run") >= length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % noise == 0, F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= length) & (F.col("n") >= count))


def _dealt(words: DataFrame, shards: int) -> DataFrame:
    """(shard, size, word, n, start): each word for each segment of its own length, at which it is held and asked for, and for
    each segment of the words one longer, at which it is asked for."""
    size = F.length("word")
    starts = lambda most: F.sequence(F.lit(0), most - 1, F.lit(SEGMENT))
    both = words.select(
        "word",
        "n",
        F.explode(F.concat(F.transform(starts(size), lambda a: F.struct(size.alias("size"), a.alias("start"))), F.transform(starts(size + 1), lambda a: F.struct((size + 1).alias("size"), a.alias("start"))))).alias("x"),
    )
    rest: Column = F.col("x.start") + SEGMENT + size - F.col("x.size")  # what of the word stands before the part behind the segment
    key = F.xxhash64("x.size", "x.start", F.substr("word", F.lit(1), F.col("x.start")), F.substr("word", rest + 1))
    return both.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.col("x.size").cast("int").alias("size"), "word", "n", F.col("x.start").cast("int").alias("start"))


def _of_one_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (shard, size), from rows in that order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        shard, size = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (size[1:] != size[:-1])) + 1).tolist(), len(shard)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and (shard[a], size[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = (shard[a], size[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in _of_one_tree(batches):
        size = whole["size"][0].as_py()
        words = np.array([w.encode("latin-1") for w in whole["word"].to_pylist()], dtype="S")
        n, start = whole["n"].to_numpy(), whole["start"].to_numpy()
        lengths = np.char.str_len(words)
        own = np.flatnonzero(lengths == size)
        held, first = np.unique(words[own].astype(f"S{size}"), return_index=True)
        if not len(held):
            continue
        held_n = n[own][first]
        for shorter in (0, 1):
            at = np.flatnonzero(lengths == size - shorter)
            at = np.repeat(at, SEGMENT)
            position = start[at] + np.tile(np.arange(SEGMENT), len(at) // SEGMENT)
            at, position = at[position < size], position[position < size]
            if not len(at):
                continue
            asked = words[at].astype(f"S{size - shorter}")
            q, hit = near_words(held, asked, position)
            if not shorter:
                other = asked[q] != held[hit]
                q, hit = q[other], hit[other]
            text = lambda x: pa.array([w.decode("latin-1") for w in x.tolist()], pa.string())
            near = [text(asked[q]), text(held[hit])]
            yield pa.RecordBatch.from_arrays([near[0], near[1], pa.array(held_n[hit], pa.int64())], ["word", "near", "near_n"])
            if shorter:
                yield pa.RecordBatch.from_arrays([near[1], near[0], pa.array(n[at][q], pa.int64())], ["word", "near", "near_n"])


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n): both ways, each pair of words (word, n), each given once, that differ by exactly one code point inserted,
    deleted or replaced. Words have code points below 256."""
    rows = words.agg(F.sum(2 * F.ceil((F.length("word") + 1) / SEGMENT))).first()[0] or 0
    shards = max(1, int(rows) // SHARD, int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _dealt(words, shards).repartition(shards, "shard").sortWithinPartitions("shard", "size")
    return dealt.mapInArrow(_links, "word string, near string, near_n long").distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each row of words (word, n), each given once.

    A word's form is its near word of largest n, of equal ones the smallest in code-point order, if that is at least `times` its own n. root is the end
    of the forms from a word, the word itself if it has none. As n grows along forms, they never meet again; pointers are doubled, so a chain of k forms
    takes some log2(k) joins. An empty table gives an empty result."""
    per = links(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    joined = words.join(per, "word", "left")
    most = -F.col("best.less")
    is_form = most >= times * F.col("n")
    named = stored(joined.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, most).alias("form_n")), "forms")
    step = stored(named.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while step.count():
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        further = stored(step.join(ahead, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        step = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            break
    return named.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all documents."""
    return variants(stored(word_counts(table(spark, sf_dir, "documents")), "words"))
