"""Documents drawn to resemble a target: hashed word n-grams weighed by how much commoner they are there, Gumbel noise, exact top draw.

Words are runs of bytes, so a batch's words are cut and lower-cased as arrays, each different word is hashed once, and the
hash of two words is put together from theirs: the checksum of a concatenation is the first one's, moved
on by the length of the second, xor the second one's. Counts and gains are arrays over the buckets.

The exact cut comes from a histogram of the scores, of which there are under SCORES different ones. Eligible rows above
or at it are sorted to runs inside their partitions and written to the shared folder in blocks, cut at the boundaries between
ranges. A range's task merges its runs by a tournament tree and stops at the exact count. A range's first rank
is the number of rows in the ranges before it, so no task sees all that is drawn.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_sample, stored, table, text_of

# Fixed values of the contract.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7

RANGE_ROWS = 250_000  # rows that a task merges, on average
RUN_ROWS = 1 << 18  # rows that are sorted together
BLOCK_ROWS = 2048  # rows of a run that are sent as one
MOST_BYTES = 1 << 23  # of texts that are worked on together, unless one is longer
#: Different scores: a gain is within 1000 * ln(2 ** 64) of zero, and noise between -3,200 and 22,900.
SCORES = 120_000
#: Lengths of a second word up to which moving a checksum on is a table.
TABLE_LENGTHS = 64

WORD = np.zeros(256, bool)
WORD[list(range(0x30, 0x3A)) + list(range(0x41, 0x5B)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_moves: dict[int, np.ndarray] = {}


def moved(n: int) -> np.ndarray:
    """Table [byte's place, byte] whose entries, xored, give a checksum moved on by n bytes."""
    if n not in _moves:
        zeros, none = bytes(n), zlib.crc32(bytes(n))
        _moves[n] = np.array([[zlib.crc32(zeros, b << (8 * k)) ^ none for b in range(256)] for k in range(4)], np.uint32)
    return _moves[n]


def word_array(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in order, as a dictionary array of bytes, and the number of words of each text."""
    whole = texts.cast(pa.large_binary())  # a slice of a batch has an offset, before the cast and after it
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1] if len(whole) else np.zeros(1, np.int64)
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = WORD[raw]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(raw)]
    fresh[heads] = inside[heads]  # a word never goes on into the next text
    kept = LOWER[raw[inside]]
    starts = np.flatnonzero(fresh[inside])
    bounds = np.append(starts, len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(kept.tobytes())])
    before = np.concatenate(([0], np.cumsum(fresh)))
    return words.dictionary_encode(), before[ends[1:]] - before[ends[:-1]]


def feature_buckets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, text of every feature, words of every text): runs of one and of two words, repeats counted."""
    words, n_words = word_array(texts)
    of = np.repeat(np.arange(len(n_words)), n_words)
    known = words.dictionary.to_pylist()
    one = np.array([zlib.crc32(w) for w in known], np.uint32)
    second = np.array([zlib.crc32(b" " + w) for w in known], np.uint32)
    length = np.array([len(w) + 1 for w in known], np.int64)
    code = words.indices.to_numpy()
    pair = np.flatnonzero(of[1:] == of[:-1])
    a, b = code[pair], code[pair + 1]
    two = second[b].copy()
    lengths = length[b]
    short = lengths <= TABLE_LENGTHS
    tables = np.stack([moved(k) for k in range(TABLE_LENGTHS + 1)])
    x, n = one[a[short]], lengths[short]
    for k in range(4):
        two[short] ^= tables[n, k, (x >> np.uint32(8 * k)) & np.uint32(255)]
    for k in np.flatnonzero(~short).tolist():
        two[k] = zlib.crc32(known[b[k]], zlib.crc32(b" ", int(one[a[k]])))
    return np.concatenate((one[code], two)) % np.uint32(buckets), np.concatenate((of, of[pair])), n_words


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have MOST_BYTES together, or one text."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, before + MOST_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _portions(batch, 0):
                sums += np.bincount(feature_buckets(part.column(0), buckets)[0], minlength=buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["bucket", "n"])

    found = texts.select(text_of(texts).alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():  # one row for each bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket 1000 times the log of the smoothed shares' ratio, rounded down."""
    n, big_s, big_t = len(source), float(source.sum()), float(target.sum())
    pairs = zip(source.astype(float).tolist(), target.astype(float).tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (big_s + n) / ((s + 1) * (big_t + n)))) for s, t in pairs], np.int64)


def noise(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row; a null doc_id counts as empty text in its noise."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, 2):
                bucket, of, n_words = feature_buckets(part.column(2), len(gain))
                n = np.bincount(of, minlength=part.num_rows)
                sums = np.zeros(part.num_rows, np.int64)
                np.add.at(sums, of, gain[bucket])
                weight = sums // np.maximum(n, 1)
                score = weight + np.array([noise(x) for x in part.column(1).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", h.alias("h"), text_of(docs).alias("text")).mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


class TournamentTree:
    """Sorted runs play by their heads; a node keeps the loser, so the next winner is found on one path to the root."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * len(runs)
        self.winner = self._play(1) if runs else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def _play(self, node: int) -> int:
        """The winner of the matches below a node; leaves follow the inner nodes."""
        if node >= len(self.runs):
            return node - len(self.runs)
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return win

    def pop(self) -> tuple | None:
        """The least head of all runs; None once all have ended."""
        best = self.winner
        out = self.heads[best] if best >= 0 else None
        if out is not None:
            self.heads[best] = next(self.runs[best], None)
            node = (best + len(self.runs)) // 2
            while node:
                if self._beats(self.losers[node], best):
                    best, self.losers[node] = self.losers[node], best
                node //= 2
            self.winner = best
        return out

    def rest(self) -> Iterator[tuple]:
        """What is left of the runs, without order."""
        for head, run in zip(self.heads, self.runs):
            if head is not None:
                yield head
                yield from run


NO_DOC = np.iinfo(np.int64).max  # stands for a null doc_id, which comes last among equal scores
BLOCK = "range int, run long, less long, doc long, row long, n long, keys binary, rest binary"


def _cut(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each sorted key: the number of bounds at or before it. Both have columns (less, doc, row)."""
    both = np.concatenate((bounds, keys))
    order = np.lexsort((np.arange(len(both)) >= len(bounds), both[:, 2], both[:, 1], both[:, 0]))
    return np.cumsum(order < len(bounds))[order >= len(bounds)]


def sorted_runs(rows: DataFrame, bounds: np.ndarray) -> DataFrame:
    """Blocks of sorted runs from rows (row, doc_id, n_features, weight, score), each of one run and range. less is minus the score."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        row, doc, features, weight, score = (np.concatenate([p.column(k).fill_null(NO_DOC).to_numpy() for p in parts]) for k in range(5))
        order = np.lexsort((row, doc, -score))
        keys, rest = np.stack((-score, doc, row), axis=1)[order], np.stack((features, weight), axis=1)[order]
        part = _cut(keys, bounds)
        starts = np.union1d(np.flatnonzero(part[1:] != part[:-1]) + 1, np.arange(0, len(keys), BLOCK_ROWS))
        ends = np.append(starts[1:], len(keys))
        run = np.full(len(starts), row.min())  # a row is of one run only
        columns = [part[starts].astype(np.int32), run, *keys[starts].T.copy(), ends - starts, *([x[a:b].tobytes() for a, b in zip(starts, ends)] for x in (keys, rest))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in BLOCK.split(", ")])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= RUN_ROWS:
                yield block(held)
                held = []
        if sum(b.num_rows for b in held):
            yield block(held)

    return rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score").mapInArrow(runs, BLOCK)


def _rows_of(blocks: list[tuple[bytes, bytes]]) -> Iterator[tuple]:
    for keys, rest in blocks:
        a, b = np.frombuffer(keys, np.int64).reshape(-1, 3), np.frombuffer(rest, np.int64).reshape(-1, 2)
        yield from map(tuple, np.concatenate((a, b), axis=1).tolist())


RANKED = "doc_id long, n_features long, weight long, score long, rank long"


def merged_ranges(blocks: DataFrame, firsts: np.ndarray, most: int) -> DataFrame:
    """RANKED rows of the blocks, of which the first `most` in order have ranks; firsts has the rank before each range's first row."""

    def emit(found: list[tuple]) -> pa.RecordBatch:
        less, doc, _, features, weight, rank = (list(c) for c in zip(*found))
        columns = [[None if d == NO_DOC else d for d in doc], features, weight, [-x for x in less], rank]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in RANKED.split(", ")])

    def of_range(at: int, runs: dict[int, list[tuple[bytes, bytes]]]) -> Iterator[pa.RecordBatch]:
        tree = TournamentTree([_rows_of(b) for b in runs.values()])
        found = []
        for rank in range(int(firsts[at]) + 1, most + 1):
            if (row := tree.pop()) is None:
                break
            found.append((*row, rank))
            if len(found) == 1 << 14:
                yield emit(found)
                found = []
        found += ((*row, None) for row in tree.rest())
        if found:
            yield emit(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, runs = None, {}
        for batch in batches:
            for part, run, keys, rest in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if part != at and runs:
                    yield from of_range(at, runs)
                    runs = {}
                at = part
                runs.setdefault(run, []).append((keys, rest))
        if runs:
            yield from of_range(at, runs)

    dealt = blocks.repartition(len(firsts), "range").sortWithinPartitions("range", "run", "less", "doc", "row")
    return dealt.select("range", "run", "keys", "rest").mapInArrow(merge, RANKED)


def ranked(rows: DataFrame, most: int, histogram: list[tuple[int, int]]) -> DataFrame:
    """RANKED rows of rows (row, doc_id, n_features, weight, score, eligible): the `most` eligible ones of the highest scores, ties to the smaller doc_id
    with null last and then by row, have ranks from 1. histogram has how many eligible rows each score has; its total is at least `most`."""
    reached, least = 0, None
    for score, n in sorted(histogram, reverse=True):
        if reached >= most:
            break
        reached, least = reached + n, score
    if least is None:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    runs = F.col("eligible") & (F.col("score") >= least)
    inside = rows.where(runs)
    n_ranges = -(-reached // RANGE_ROWS)
    bounds = np.zeros((0, 3), np.int64)
    if n_ranges > 1:
        sample = bounded_sample(inside.select("score", F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_DOC))).alias("doc_id"), "row"), F.col("row"), 64 * n_ranges)
        keys = np.array(sorted((-s, d, r) for s, d, r in sample.collect()), np.int64)  # some tuples for each range
        bounds = keys[np.arange(1, n_ranges) * len(keys) // n_ranges]
    blocks = stored(sorted_runs(inside, bounds), "runs")
    sizes = np.zeros(len(bounds) + 1, np.int64)
    for at, n in blocks.groupBy("range").agg(F.sum("n")).collect():  # one row for each range
        sizes[at] = n
    drawn = merged_ranges(blocks, np.cumsum(sizes) - sizes, most)
    return drawn.unionByName(rows.where(~runs).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), one row per row of docs, of which `percent` of those with least_words and more are
    drawn. target (text) is what they shall resemble.

    Null and empty texts have no features and the weight 0. A null doc_id counts as empty text in its noise and comes last
    among ties; repeated rows are drawn each for itself. Empty tables give an empty result, or weights against no target. Other columns are ignored."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    found = scored(docs, gain, seed).withColumn("eligible", F.col("n_words") >= least_words)
    found = stored(found.drop("n_words").withColumn("row", F.monotonically_increasing_id()), "scores")
    histogram = [tuple(r) for r in found.where("eligible").groupBy("score").count().collect()]  # SCORES rows at most
    return ranked(found, percent * sum(n for _, n in histogram) // 100, histogram)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn to resemble the benchmark."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
