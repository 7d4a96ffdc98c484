"""Removal of long strings that occur more than once, by sharded suffix arrays.

A string of `length` bytes is dealt to a shard by the smallest hash of the short grams in it, which
equal strings have in common wherever they stand. The strings that start one after the other with the
same smallest gram make a run; the bytes under a run are its context. Runs whose gram is met once in
all documents can't repeat and go no further. Of the others, equal contexts are gathered into one
weighted row, and the contexts of a gram are sorted together: the suffix array of a block of contexts
is induced, and the classes of equal strings are read off its common prefixes.

The contexts of a gram that is met very often are dealt out to several blocks. Each block then gives
a digest for each of its classes, and classes with the same digest in different blocks are joined, so
no task holds more than a block and nothing is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import digest_map, maybe_among, over_batches, spread_join, stored, table, text_of
from ledgerlake.llm.suffix_array import repeated_starts

LENGTH = 400
SLICE = 1 << 18  # starts of a long text that are looked at together
GROUP = 1 << 15  # bytes of short texts that are looked at together
BLOCK = 1 << 20  # bytes of contexts that a suffix array holds, unless one gram has more
HOT = 1 << 23  # bytes of contexts from which on a gram is dealt out to several blocks
BROADCAST_ROWS = 1_000_000  # grams that are dealt out are broadcast up to so many (of 12 bytes each)
PLACE = 10  # low bits of a gram's key that hold its place
FACTORS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_width(length: int) -> int:
    """The largest power of two, up to 64, that is at most half the length."""
    return 1 << min(6, max(0, (length // 2).bit_length() - 1))


class Windows:
    """The smallest gram of every `length`-byte string inside each of several texts."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        width = gram_width(length)
        self.span = length - width + 1  # grams in a string
        if self.span >= 1 << PLACE:
            raise ValueError("the length is out of range")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.cumsum(sizes) - sizes
        h = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64) + np.uint64(1)
        step = 1
        while step < width:
            h = h[:-step] * FACTORS[step.bit_length() - 1] + h[step:]
            step *= 2
        h ^= h >> np.uint64(29)
        h *= FACTORS[1]
        h ^= h >> np.uint64(32)
        low = np.uint64((1 << PLACE) - 1)
        self.hash = h >> np.uint64(PLACE)
        x = (h & ~low) | (~np.arange(len(h), dtype=np.uint64) & low)
        step = 1
        while step * 2 <= self.span:
            x = np.minimum(x[:-step], x[step:])
            step *= 2
        if step < self.span:
            x = np.minimum(x[: len(x) - (self.span - step)], x[self.span - step :])
        counts = sizes - length + 1
        self.at = np.concatenate([np.arange(o, o + n) for o, n in zip(self.offset.tolist(), counts.tolist())])
        x = x[self.at]
        self.value = x >> np.uint64(PLACE)
        self.place = self.at + ((~x & low).astype(np.int64) - self.at & int(low))
        fresh = np.concatenate(([True], (self.value[1:] != self.value[:-1]) | (self.at[1:] != self.at[:-1] + 1)))
        first = np.cumsum(counts) - counts
        fresh[first] = True
        self.first = np.flatnonzero(fresh)
        self.stop = np.concatenate((self.first[1:], [len(x)]))
        self.owner = np.searchsorted(first, self.first, side="right") - 1

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of grams such that each string holds one with its smallest hash. A gram that is
        met again within a string's reach is given twice, since strings may then repeat around it."""
        owners, places = [], []
        first, stop, owner = self.first, self.stop, self.owner
        while len(first):
            p = self.place[first]
            owners.append(owner)
            places.append(p)
            after = first + (p - self.at[first]) + 1
            more = stop > after
            first, stop, owner = after[more], stop[more], owner[more]
        owner, place = np.concatenate(owners), np.concatenate(places)
        by = np.lexsort((place, owner))
        owner, place = owner[by], place[by]
        keep = np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])))
        owner, place = owner[keep], place[keep]
        reach = self.span - 1
        padded = np.concatenate((np.zeros(reach, np.uint64), self.hash, np.zeros(reach, np.uint64)))
        around = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
        again = np.zeros(len(place), bool)
        for k in range(0, len(place), 512):
            p = place[k : k + 512]
            again[k : k + 512] = (around[p] == self.hash[p][:, None]).sum(axis=1) > 1
        return np.concatenate((owner, owner[again])), self.hash[np.concatenate((place, place[again]))].view(np.int64)


def slices(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(numbers, offsets, parts) of texts of at least `length` bytes, in groups of bounded size."""
    numbers, offsets, parts, held = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, SLICE):
            part = t[at : at + SLICE + length - 1] if len(t) > SLICE else t
            if held and held + len(part) > GROUP:
                yield numbers, offsets, parts
                numbers, offsets, parts, held = [], [], [], 0
            numbers.append(k)
            offsets.append(at)
            parts.append(part)
            held += len(part)
    if parts:
        yield numbers, offsets, parts


def _lists(owner: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    by = np.argsort(owner, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[by]))


def _prints(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, d, sha256, n_bytes, marks): d is the first half of the text's digest."""

    def make(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        owners, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for numbers, _, parts in slices(texts, length):
            owner, mark = Windows(parts, length).marks()
            owners.append(np.array(numbers)[owner])
            marks.append(mark)
        sha = [hashlib.sha256(t).digest() for t in texts]
        return {
            "doc_id": batch.column(0),
            "d": pa.array([x[:16] for x in sha], pa.binary()),
            "sha256": pa.array([x.hex() for x in sha]),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "marks": _lists(np.concatenate(owners), np.concatenate(marks), len(texts)),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs, make, f"doc_id {kind}, d binary, sha256 string, n_bytes long, marks array<long>")


def _runs(candidates: DataFrame, length: int) -> DataFrame:
    """(d, start, context_id, gram, weight, context): a row for each run whose gram is among the text's marks."""

    def make(batch: pa.RecordBatch) -> dict:
        ids, weights, texts, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
        rows: dict[str, list] = {c: [] for c in ("d", "start", "context_id", "gram", "weight", "context")}
        wanted = [np.sort(x.values.to_numpy(zero_copy_only=False)) for x in marks]
        for numbers, offsets, parts in slices(texts, length):
            w = Windows(parts, length)
            gram = w.value[w.first].view(np.int64)
            for k in range(len(parts)):
                mine = np.flatnonzero(w.owner == k)
                mine = mine[np.isin(gram[mine], wanted[numbers[k]])]
                base = int(w.offset[k])
                for r in mine.tolist():
                    a = int(w.at[w.first[r]]) - base
                    context = parts[k][a : a + int(w.stop[r] - w.first[r]) + length - 1]
                    rows["d"].append(ids[numbers[k]])
                    rows["start"].append(offsets[k] + a)
                    rows["context_id"].append(hashlib.blake2b(context, digest_size=16).digest())
                    rows["gram"].append(int(gram[r]))
                    rows["weight"].append(weights[numbers[k]])
                    rows["context"].append(context)
        kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        return {c: pa.array(v, kind) for (c, v), kind in zip(rows.items(), kinds)}

    return over_batches(candidates.select("d", "weight", "text", "marks"), make, "d binary, start int, context_id binary, gram long, weight long, context binary")


def _spans_of(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (owner, first, stop) of starts."""
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    fresh = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))))
    last = np.concatenate((fresh[1:], [len(owner)])) - 1
    return owner[fresh], start[fresh], start[last] + 1


def _judged(dealt: DataFrame, length: int) -> DataFrame:
    """(context_id, spans, digest, start, weight): the starts of repeated strings of a context as flat
    pairs of first and stop, or, for the contexts of a gram in several blocks, a row for each start."""
    schema = "context_id binary, spans array<int>, digest binary, start int, weight long"

    def judge(block: list[tuple], salted: bool) -> pa.RecordBatch:
        ids, weights, contexts = (list(x) for x in zip(*block))
        owner, start, group = repeated_starts(contexts, length)
        total = np.bincount(group, weights=np.array(weights, np.float64)[owner])
        names = pa.array(ids, pa.binary())
        if not salted:
            hit = total[group] >= 2
            o, a, b = _spans_of(owner[hit], start[hit]) if hit.any() else (np.zeros(0, np.int64),) * 3
            have = np.unique(o)
            spans = _lists(np.searchsorted(have, np.repeat(o, 2)), np.stack((a, b), axis=1).reshape(-1).astype(np.int32), len(have))
            n = len(have)
            return pa.RecordBatch.from_arrays([names.take(pa.array(have)), spans, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names=["context_id", "spans", "digest", "start", "weight"])
        _, first = np.unique(group, return_index=True)
        digests = [hashlib.blake2b(contexts[o][a : a + length], digest_size=16).digest() for o, a in zip(owner[first].tolist(), start[first].tolist())]
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(owner)), pa.nulls(len(owner), pa.list_(pa.int32())), pa.array(digests, pa.binary()).take(pa.array(group)), pa.array(start.astype(np.int32)), pa.array(np.array(weights, np.int64)[owner])],
            names=["context_id", "spans", "digest", "start", "weight"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, at, many = [], 0, None, False
        for batch in batches:
            for gram, salt, blocks, name, weight, context in zip(*(c.to_pylist() for c in batch.columns)):
                if block and (gram, salt) != at and (held > BLOCK or many or blocks > 1):
                    yield judge(block, many)
                    block, held = [], 0
                at, many = (gram, salt), blocks > 1
                block.append((name, weight, context))
                held += len(context)
        if block:
            yield judge(block, many)

    return dealt.mapInArrow(run, schema)


def placed_runs(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prints, candidates, placed). prints: (doc_id, d, sha256, n_bytes), a row for each row of docs; candidates: (d, text) of the texts that may have
    repeats, maybe twice; placed: (d, found), for each different text with a repeated string the runs (start, spans) that hold them: spans are
    flat pairs of the first start of a repeated string and that after the last, counted from start. d is the first 16 bytes of a text's SHA-256.

    A null text counts as empty. Repeated rows are documents of their own and so repeat each other.
    Texts shorter than `length` bytes have no repeats; an empty table gives empty results. Columns other
    than doc_id and text are ignored.
    """
    rows = docs.select("doc_id", text_of(docs).cast("binary").alias("text"))
    prints = stored(_prints(rows, length), "suffix-prints")
    copies = prints.groupBy("d").agg(F.count("*").alias("weight"), F.min("doc_id").alias("rep"))
    marks = prints.select("d", F.explode("marks").alias("mark"))
    often = stored(marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1"), "suffix-marks")
    shared = spread_join(marks.distinct(), often.select("mark"), ["mark"], F.col("d"), "left_semi", sizes=often)
    by_text = shared.groupBy("d").agg(F.collect_list("mark").alias("marks"))
    wanted = by_text.join(copies, "d").withColumnRenamed("d", "wd")
    digest = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    texts = rows.withColumn("d", digest)
    wanted = stored(wanted, "suffix-wanted")
    near = stored(digest_map(wanted, "wd"), "suffix-map")
    texts = maybe_among(texts, F.col("d"), near).where("__maybe").drop("__maybe")  # most of the others stay where they are
    candidates = stored(texts.join(wanted, (texts["d"] == wanted["wd"]) & texts["doc_id"].eqNullSafe(wanted["rep"])).select("d", "weight", "text", "marks"), "suffix-texts")
    runs = stored(_runs(candidates, length), "suffix-runs")
    contexts = stored(runs.groupBy("context_id").agg(F.first("gram").alias("gram"), F.sum("weight").alias("weight"), F.first("context").alias("context")), "suffix-contexts")
    grams = contexts.groupBy("gram").agg(F.sum(F.octet_length("context")).alias("bytes")).where(F.col("bytes") > hot)
    large = stored(grams.select("gram", F.ceil(F.col("bytes") / hot).cast("int").alias("blocks")), "suffix-grams")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    sized = contexts.join(large, "gram", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sized = sized.withColumn("salt", F.pmod(F.xxhash64("context_id"), F.col("blocks")).cast("int"))
    dealt = sized.repartition("gram", "salt").sortWithinPartitions("gram", "salt").select("gram", "salt", "blocks", "context_id", "weight", "context")
    judged = stored(_judged(dealt, length), "suffix-judged")
    one_block = judged.where("spans is not null").select("context_id", "spans")
    pieces = judged.where("digest is not null")
    again = pieces.groupBy("digest").agg(F.sum("weight").alias("n")).where("n > 1").select("digest")
    starts = pieces.join(again, "digest").groupBy("context_id").agg(F.flatten(F.collect_list(F.array("start", F.col("start") + 1))).alias("spans"))
    found = one_block.unionByName(starts)
    placed = spread_join(runs.select("d", "start", "context_id"), found, ["context_id"], F.col("d")).groupBy("d").agg(F.collect_list(F.struct("start", "spans")).alias("found"))
    return prints.drop("marks"), candidates.select("d", "text"), placed


def cut_out(text: bytes, runs: list[dict], length: int) -> tuple[list[list[int]], bytes]:
    """The maximal byte ranges of a text that its runs cover, and the bytes outside of them."""
    ranges = sorted((r["start"] + a, r["start"] + b - 1 + length) for r in runs for a, b in zip(r["spans"][::2], r["spans"][1::2]))
    merged: list[list[int]] = []
    for a, b in ranges:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    edges = [0, *(x for m in merged for x in m), len(text)]
    return merged, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(prints, cuts). prints as in placed_runs(), which says what holds in each case; cuts: (d, spans, kept, kept_sha256) for each different text with a
    repeated string: spans are the maximal removed byte ranges (start, stop), kept the other bytes."""
    prints, candidates, placed = placed_runs(docs, length, hot)

    def make(batch: pa.RecordBatch) -> dict:
        found = [cut_out(text, runs, length) for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        spans = [[{"start": a, "stop": b} for a, b in merged] for merged, _ in found]
        return {"d": batch.column(0), "spans": pa.array(spans, kind), "kept": pa.array([x for _, x in found], pa.binary()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for _, x in found])}

    each = candidates.dropDuplicates(["d"]).join(placed, "d")  # a repeated row has come twice
    return prints, over_batches(each.select("d", "text", "found"), make, "d binary, spans array<struct<start:long,stop:long>>, kept binary, kept_sha256 string")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256), one row per row of docs; see repeats() for each case."""
    prints, cuts = repeats(docs, length)
    none = F.expr("cast(array() as array<struct<start:bigint,stop:bigint>>)")
    return spread_join(prints, cuts.drop("kept"), ["d"], F.col("doc_id"), "left").select("doc_id", "n_bytes", F.coalesce("spans", none).alias("spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def _with_places(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(moved, rest): together the rows of docs. moved have __found too, the runs of placed_runs() or null; rest have no repeats. Texts whose digest
    a map of fixed size rules out aren't moved, the others once."""
    prints, _, placed = placed_runs(docs, length)
    copies = prints.groupBy(F.col("d").alias("__own")).agg(F.count("*").alias("n"))
    found = stored(placed.select(F.col("d").alias("__own"), F.col("found").alias("__found")), "suffix-cuts")
    digest = F.unhex(F.substring(F.sha2(text_of(docs).cast("binary"), 256), 1, 32))
    flagged = maybe_among(docs.withColumn("__own", digest), F.col("__own"), stored(digest_map(found, "__own"), "suffix-map"))
    moved = spread_join(flagged.where("__maybe").drop("__maybe"), found, ["__own"], docs["doc_id"], "left", sizes=copies)
    return moved, flagged.where(~F.col("__maybe"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated strings cut out of text; all rows and columns stay, whatever their names. A character that a cut goes
    through is dropped. A long n_chars is brought up to date where text has changed.

    A null text stays null, an empty one and those shorter than `length` bytes stay as they are, long ones are cut whole. Repeated rows are
    documents of their own, so both lose what they share; there are no ties, since no copy is kept. An empty table stays empty."""
    moved, rest = _with_places(docs, length)
    names = docs.columns
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names and docs.schema["n_chars"].dataType.simpleString() == "bigint" else None

    def cut(batch: pa.RecordBatch) -> dict:
        runs = batch.column(len(names)).to_pylist()
        texts = batch.column(at).to_pylist()
        new = [x if not r else cut_out((x or "").encode(), r, length)[1].decode("utf-8", "ignore") for x, r in zip(texts, runs)]
        columns = {n: batch.column(k) for k, n in enumerate(names)}
        columns["text"] = pa.array(new, pa.string())
        if counted is not None:
            columns["n_chars"] = pa.array([n if not r else len(x) for n, x, r in zip(batch.column(counted).to_pylist(), new, runs)], pa.int64())
        return columns

    cut_rows = over_batches(moved.select(*(f"`{c}`" for c in names), "__found"), cut, docs.schema)
    return cut_rows.unionByName(rest.select(*(f"`{c}`" for c in names)))


def kept_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text), one row per row of docs: bytes and maximal ranges that go, the digest of the bytes
    that stay, and these as text, less what is left of a character that a cut goes through.

    A null text counts as empty and gives an empty one; texts shorter than `length` bytes stay as they are, long ones are cut whole. Repeated rows
    are documents of their own, so each loses what they share; there are no ties, since no copy is kept. An empty table gives an empty result."""
    moved, rest = _with_places(docs.select("doc_id", text_of(docs).cast("binary").alias("text")), length)

    def cut(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        done = [cut_out(x, r or [], length) for x, r in zip(texts, batch.column(2).to_pylist())]
        return {
            "doc_id": batch.column(0),
            "n_bytes": pa.array([len(x) for x in texts], pa.int64()),
            "n_removed": pa.array([sum(b - a for a, b in merged) for merged, _ in done], pa.int64()),
            "n_spans": pa.array([len(merged) for merged, _ in done], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for _, x in done], pa.string()),
            "text": pa.array([x.decode("utf-8", "ignore") for _, x in done], pa.string()),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut_rows = over_batches(moved.select("doc_id", "text", "__found"), cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    none = F.lit(0).cast("long")
    whole = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("string").alias("text"))
    return cut_rows.unionByName(whole)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_texts(table(spark, sf_dir, "documents"))
