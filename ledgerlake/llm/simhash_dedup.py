"""Near-duplicate groups by SimHash fingerprints and vantage-point trees.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Fingerprints
within a few bits of each other are linked. The links are found exactly by a vantage-point tree whose
upper part deals the distinct fingerprints out to shards and whose lower part is built in each shard:
at every node the distance d to a vantage point divides the points at a radius mu, and by the triangle
inequality a point inside can only have partners outside if mu - r < d <= mu. Those boundary points
alone are copied outside, so each pair is met in at least one leaf.

Shards hold distinct fingerprints only, with the smallest doc_id of each; copies of a text are
gathered by partial aggregation before. A shard returns a star for each group it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_sample, digest_map, maybe_among, over_batches, spread_join, stored, table, text_of
from ledgerlake.llm.graph import components

SEED = 42
SAMPLE = 1 << 14  # fingerprints that lay out the upper tree, more for many shards
MOST_SAMPLE = 1 << 20  # at most
SHARD = 1 << 15  # fingerprints a shard should hold
LEAF = 128
VIEW_SHINGLES = 3
VIEWS = 8
VIEW_RADIUS = 2
MINIMA = 256  # orders of all shingles whose first one, as a byte, is kept of each text
#: Shares of equal bytes from which on a pair is compared: four deviations of 0.025 below SIMILAR.
LIKELY = 0.7
DENSE = 2048
BLOCK = 512  # rows of a view's shard that are one part
#: The same where only rows of different roots meet, and the shingles that a part has on average at most: 64 MB.
LAST_BLOCK, LAST_SHINGLES = 4096, 1 << 23
SIMILAR = 0.8  # Jaccard similarity of shingles from which documents are near copies
#: Row numbers of texts to be compared are broadcast up to so many.
BROADCAST_ROWS = 400_000


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """XXH64 of each word shingle of the whole text, in blocks. A-Z become lower case; words are runs
    without ASCII white space; fewer words than `width` make one shingle; no word makes none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    whole = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        yield np.array([digest(whole, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - width + 1
    for at in range(0, n, 1 << 15):
        s, e = starts[at : min(n, at + (1 << 15))].tolist(), (ends[at + width - 1 : min(n, at + (1 << 15)) + width - 1] - 1).tolist()
        yield np.fromiter((digest(whole[i:j], SEED) for i, j in zip(s, e)), np.uint64, len(s))


def majority(blocks: Iterator[np.ndarray] | list[np.ndarray]) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half the hashes; without hashes 0."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint(text: str, width: int) -> int:
    return majority(shingle_hashes(text, width))


@lru_cache(maxsize=8)
def _orders(seed: int, n: int) -> np.ndarray:
    """Odd factors, each of which puts hashes into an order of its own."""
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def _majority_of_few(h: np.ndarray) -> int:
    """majority() of three hashes at most, bit by bit at once."""
    if len(h) == 3:
        a, b, c = h.tolist()
        return (a & b) | (a & c) | (b & c)
    return int(np.bitwise_and.reduce(h)) if len(h) else 0


def view_fingerprints(blocks: list[np.ndarray], views: int) -> list[int]:
    """SimHash of the VIEW_SHINGLES shingles that come first in each of several orders of all shingles."""
    out = []
    for factor in _orders(SEED, views):
        some = np.zeros(0, np.uint64)
        for h in blocks:
            h = h * factor
            h = np.partition(h, VIEW_SHINGLES)[:VIEW_SHINGLES] if len(h) > VIEW_SHINGLES else h
            some = np.unique(np.concatenate((some, h)))[:VIEW_SHINGLES]
        out.append(_majority_of_few(some))
    return out


def first_shingles(hashes: np.ndarray) -> bytes:
    """A byte of the shingle that comes first in each of MINIMA orders: two texts have as large a share of
    equal bytes as their different shingles have in common, but for chance. Orders are of the upper 32 bits, which are multiplied many at a time."""
    orders = (_orders(SEED + 1, MINIMA) >> np.uint64(20)).astype(np.uint32) | np.uint32(1)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 2048):
        np.minimum(least, (high[None, at : at + 2048] * orders[:, None]).min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def with_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. A null text counts as empty."""

    def make(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((fingerprint(t, width) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", text_of(docs).alias("text")), make, f"doc_id {kind}, fp long")


def _split(d: np.ndarray, radius: int) -> tuple[float, int]:
    """The cost (size of the larger side, boundary included) and radius mu of the best division."""
    upto = np.cumsum(np.bincount(d, minlength=65))
    mus = np.arange(65)
    outside = len(d) - np.where(mus - radius >= 0, upto[np.maximum(mus - radius, 0)], 0)
    cost = np.maximum(upto, outside) + 0.5 * (upto + outside)
    cost = np.where((upto == 0) | (upto == len(d)), np.inf, cost)
    mu = int(np.argmin(cost))
    return float(max(upto[mu], outside[mu])), mu


def upper_tree(sample: np.ndarray, total: int, radius: int, shard: int = SHARD) -> list:
    """Nodes [vantage point, mu, inside, outside]; a negative child -k-1 is shard k. Node 0 is the root.
    An empty list means one shard. Only a bounded sample of fingerprints is looked at."""
    nodes: list = []
    leaves = 0
    scale = total / max(1, len(sample))

    def grow(points: np.ndarray) -> int:
        nonlocal leaves
        best = None
        if len(points) * scale > shard and len(points) >= 64:
            for vp in points[:: max(1, len(points) // 12)][:12]:
                d = np.bitwise_count(points ^ vp).astype(np.int64)
                size, mu = _split(d, radius)
                if best is None or size < best[0]:
                    best = (size, mu, vp, d)
        if best is None or best[0] > 0.9 * len(points):
            leaves += 1
            return -leaves
        _, mu, vp, d = best
        k = len(nodes)
        nodes.append([int(vp), mu, 0, 0])
        nodes[k][2] = grow(points[d <= mu])
        nodes[k][3] = grow(points[d > mu - radius])
        return k

    grow(sample)
    return nodes


def route(nodes: list, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, shard numbers): each row once for its home shard and once for each shard whose boundary it overlaps."""
    rows, shards = [], []
    todo = [(0 if nodes else -1, np.arange(len(fps)))]
    while todo:
        k, at = todo.pop()
        if k < 0:
            rows.append(at)
            shards.append(np.full(len(at), -k - 1, np.int32))
        elif len(at):
            vp, mu, inside, outside = nodes[k]
            d = np.bitwise_count(fps[at] ^ np.uint64(vp))
            todo.append((inside, at[d <= mu]))
            todo.append((outside, at[d.astype(np.int16) > mu - radius]))
    return np.concatenate(rows), np.concatenate(shards)


class _Groups:
    """Union of index pairs over arrays: links are pushed in bulk and folded into labels."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.pairs: list = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            self.pairs.append((i, j))
            self.held += len(i)
            if self.held > 1 << 20:
                self.fold()

    def fold(self) -> np.ndarray:
        if self.pairs:
            i, j = (np.concatenate(x) for x in zip(*self.pairs))
            label = self.label
            while True:
                a, b = label[i], label[j]
                if (a == b).all():
                    break
                low = np.minimum(a, b)
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
                while True:
                    up = label[label]
                    if (up == label).all():
                        break
                    label = up
            self.label, self.pairs, self.held = label, [], 0
        return self.label


def spread_links(points: np.ndarray, at: np.ndarray, radius: int, groups: _Groups) -> None:
    """Links each reached point to what it newly reaches: a dense ball is done after a few points."""
    rest = np.arange(len(points))
    while len(rest):
        edge, rest = rest[:1], rest[1:]
        while len(edge) and len(rest):
            some, edge = edge[:64], edge[64:]
            near = np.bitwise_count(points[some][:, None] ^ points[rest][None, :]) <= radius
            hit = near.any(axis=0)
            groups.add(at[some[near[:, hit].argmax(axis=0)]], at[rest[hit]])
            edge, rest = np.concatenate((edge, rest[hit])), rest[~hit]


def link_groups(fps: np.ndarray, radius: int) -> np.ndarray:
    """For distinct fingerprints, the index of the first member of each one's linked group."""
    groups = _Groups(len(fps))
    todo = [np.arange(len(fps))]
    while todo:
        at = todo.pop()
        points = fps[at]
        best = None
        if len(at) > LEAF:
            for vp in points[:: max(1, len(points) // 4)][:4]:
                d = np.bitwise_count(points ^ vp).astype(np.int64)
                size, mu = _split(d, radius)
                if best is None or size < best[0]:
                    best = (size, mu, d)
                if size < 0.7 * len(at):
                    break
        if best and best[0] <= 0.9 * len(at):
            _, mu, d = best
            todo.append(at[d <= mu])
            todo.append(at[d > mu - radius])
        elif radius > 2 and len(at) > DENSE:
            spread_links(points, at, radius, groups)
        elif len(at) <= DENSE:
            for k in range(0, len(at), 256):
                i, j = np.nonzero(np.bitwise_count(points[k : k + 256, None] ^ points[None, :]) <= radius)
                keep = i + k < j
                groups.add(at[i[keep] + k], at[j[keep]])
        else:  # a dense ball that no division thins out: look up every fingerprint within two bits
            order = np.argsort(points)
            ranked = points[order]
            bits = [np.uint64(1 << b) for b in range(64)]
            for mask in [*bits, *(x | y for n, x in enumerate(bits) for y in bits[:n])][: 64 if radius == 1 else None]:
                want = ranked ^ mask
                spot = np.minimum(np.searchsorted(ranked, want), len(ranked) - 1)
                hit = np.flatnonzero((ranked[spot] == want) & (want > ranked))
                groups.add(at[order[hit]], at[order[spot[hit]]])
    return groups.fold()


def _shard_links(dealt: DataFrame, radius: int) -> DataFrame:
    """(a, b): a star for each linked group of a shard, from (shard, fp, rep) partitioned by shard."""
    kind = dealt.schema["rep"].dataType.simpleString()
    names = ["shard", "fp", "rep"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = [pa.RecordBatch.from_arrays(b.columns, names) for b in batches]
        if not have:
            return
        whole = pa.Table.from_batches(have)
        shards, fps = whole["shard"].to_numpy(), whole["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fps, shards))
        fresh = np.concatenate(([True], shards[order][1:] != shards[order][:-1]))
        first = np.flatnonzero(fresh)
        sizes = np.diff(np.concatenate((first, [len(order)])))
        two = first[sizes == 2]
        near = np.bitwise_count(fps[order[two]] ^ fps[order[two + 1]]) <= radius
        pairs = [(order[two[near] + 1], order[two[near]])]
        for k, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            at = order[k : k + n]
            head = link_groups(fps[at], radius)
            linked = np.flatnonzero(head != np.arange(n))
            pairs.append((at[linked], at[head[linked]]))
        a, b = (np.concatenate(x) for x in zip(*pairs))
        for k in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([whole["rep"].take(pa.array(x[k : k + (1 << 16)])).combine_chunks() for x in (a, b)], ["a", "b"])

    return dealt.mapInArrow(link, f"a {kind}, b {kind}")


def fingerprint_components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id) for each distinct fp of (doc_id, fp): the smallest doc_id among all fingerprints that links reach, null if none has one.

    A fingerprint that only rows without doc_id have links others like any other: it gets a number over all doc_ids as its name. prints may have a
    boolean column lone too: fingerprints whose rows are all lone link others like any other, but are left out of the result where no link reaches
    their rep, so what is joined then follows those that meet others and not all."""
    may_be_lone = "lone" in prints.columns
    distinct = prints.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("rep"), *([F.min("lone").alias("lone")] if may_be_lone else []))
    distinct = stored(distinct, "fingerprints")
    total, most, nameless = distinct.agg(F.count("*"), F.coalesce(F.max("rep"), F.lit(0)), F.count_if(F.col("rep").isNull())).first()
    if nameless:
        distinct = stored(distinct.withColumn("rep", F.coalesce("rep", F.lit(most) + 1 + F.monotonically_increasing_id())), "named-fingerprints")
    sample = bounded_sample(distinct.select("fp"), F.col("fp"), min(MOST_SAMPLE, max(SAMPLE, 256 * (total // SHARD)))).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = upper_tree(sample, total, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, shard = route(nodes, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), radius)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0).take(take), batch.column(1).take(take)], ["shard", "fp", "rep"])

    dealt = distinct.select("fp", "rep").mapInArrow(deal, "shard int, fp long, rep long")
    parts = max(1, sum(c < 0 for n in nodes for c in n[2:]))
    links = _shard_links(dealt.repartition(parts, "shard"), radius)
    roots = components(links)
    rooted = lambda df, how: df.join(roots, df["rep"] == roots["node"], how).select("fp", F.coalesce("root", "rep").alias("root"))
    joined = rooted(distinct.where("not lone"), "left").unionByName(rooted(distinct.where("lone"), "inner")) if may_be_lone else rooted(distinct, "left")
    return joined.select("fp", F.when(F.col("root") <= most, F.col("root")).cast(prints.schema["doc_id"].dataType).alias("component_id"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of docs.

    Texts without words have fingerprint zero and are linked like any other. Null texts count as empty.
    Repeated rows stay repeated; a null doc_id is carried along, links others by its text and names no component: where a
    component has no other, component_id is null. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    prints = stored(with_fingerprints(docs, width), "prints")
    roots = fingerprint_components(prints, radius)
    return spread_join(prints, roots, ["fp"], F.col("doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def candidate_pairs(fps: np.ndarray, sizes: np.ndarray, roots: np.ndarray, firsts: np.ndarray, radius: int, all_pairs: bool, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within the radius, of different roots, whose numbers of shingles allow SIMILAR and whose first
    shingles (rows of MINIMA bytes) make it LIKELY. Without all_pairs each j has two at most: the first such i and the
    most alike. Of two parts, only pairs across are met."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    across = parts is not None and len(parts) > 0 and parts.min() != parts.max()
    step = max(1, (1 << 21) // max(1, len(fps)))
    for k in range(0, len(fps), step):
        j = np.arange(k, min(len(fps), k + step))
        upto = j[-1]
        d = np.bitwise_count(fps[j, None] ^ fps[None, :upto])
        few, many = np.minimum(sizes[j, None], sizes[None, :upto]), np.maximum(sizes[j, None], sizes[None, :upto])
        near = (d <= radius) & (np.arange(upto)[None, :] < j[:, None]) & (few >= SIMILAR * many) & (roots[j, None] != roots[None, :upto])
        if across:
            near &= parts[j, None] != parts[None, :upto]
        at, i = np.nonzero(near)
        alike = np.concatenate([np.zeros(0, np.int64), *((firsts[j[at[c : c + 4096]]] == firsts[i[c : c + 4096]]).sum(axis=1) for c in range(0, len(at), 4096))])
        keep = alike >= LIKELY * firsts.shape[1]
        at, i, alike = at[keep], i[keep], alike[keep]
        if not all_pairs and len(at):
            hub = np.concatenate(([True], at[1:] != at[:-1]))
            best = np.lexsort((i, -alike, at))
            hub[best[np.concatenate(([True], at[best][1:] != at[best][:-1]))]] = True
            at, i = at[hub], i[hub]
        out.append((i, j[at]))
    i, j = (np.concatenate(x) for x in zip(*out))
    return i, j


def in_blocks(sized: DataFrame) -> DataFrame:
    """Rows of (shard, rep, parts, ...) in blocks: a shard of several parts has a block for each two of them and
    for each alone, so every pair of rows meets and a block has about 2 * BLOCK rows at most. part is the row's own."""
    own = sized.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = own.withColumn("__q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.when(F.col("parts") > 1, F.xxhash64("shard", F.least("part", "__q"), F.greatest("part", "__q"))).otherwise(F.col("shard"))
    return met.withColumn("shard", block).drop("__q", "parts")


def first_blocks(sized: DataFrame) -> DataFrame:
    """Rows of (shard, rep, parts, ...) in blocks: each part of a shard has one, which the rows of its first part are in too. So rows are
    about doubled at most, whatever a shard's size, and all pairs of a block are met: every row meets its own part and the first one."""
    own = sized.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    met = own.withColumn("__q", F.explode(F.when(F.col("part") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part"))))
    block = F.when(F.col("parts") > 1, F.xxhash64("shard", "__q")).otherwise(F.col("shard"))
    return met.withColumn("shard", block).withColumn("part", F.lit(0)).drop("__q", "parts")


def last_blocks(rooted: DataFrame) -> DataFrame:
    """Rows of (shard, rep, root, ...) in blocks in which every two rows of one shard and of different roots meet. A shard of one root has
    none. Of a larger shard, the rows of the root that most of them have are parts of their own, which needn't meet each other: while the others are one part,
    rows are about doubled at most, whatever the shard's size. n is the number of a row's shingles."""
    roots = rooted.groupBy("shard", "root").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
    shards = roots.groupBy("shard").agg(F.sum("rows").alias("n"), F.sum("size").alias("size"), F.max(F.struct("rows", "root", "size")).alias("m")).where("m.rows < n")
    shards = stored(shards.select("shard", "n", "size", F.col("m.rows").alias("most"), F.col("m.root").alias("__main"), F.col("m.size").alias("main_size")), "mixed-shards")
    parts = lambda rows, size: F.greatest(F.ceil(rows / LAST_BLOCK), F.ceil(size / LAST_SHINGLES), F.lit(1)).cast("int")
    large = parts(F.col("n"), F.col("size")) > 1
    mains, others = parts(F.col("most"), F.col("main_size")), parts(F.col("n") - F.col("most"), F.col("size") - F.col("main_size"))
    laid = shards.select("shard", "__main", F.when(large, mains).otherwise(0).alias("__mains"), F.when(large, others).otherwise(1).alias("__others"))
    met = spread_join(rooted, laid, ["shard"], F.col("rep"))
    settled, place = (F.col("__mains") > 0) & (F.col("root") == F.col("__main")), F.xxhash64("rep")
    met = met.withColumn("part", F.when(settled, F.pmod(place, F.greatest("__mains", F.lit(1)))).otherwise(F.col("__mains") + F.pmod(place, F.col("__others"))).cast("int"))
    met = met.withColumn("__q", F.explode(F.sequence(F.when(settled, F.col("__mains")).otherwise(F.lit(0)), F.col("__mains") + F.col("__others") - 1)))
    block = F.when(F.col("__mains") > 0, F.xxhash64("shard", F.least("part", "__q"), F.greatest("part", "__q"))).otherwise(F.col("shard"))
    return met.withColumn("shard", block).drop("__q", "__main", "__mains", "__others")


MEMBER = ("shard", "part", "fp", "n", "rep", "root", "firsts")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, by rep, from rows sorted by their block (the first column); one block is held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        block = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[-1].column(0)[0].as_py() != block[a]:
                yield pa.Table.from_batches(held).sort_by("rep")
                held = []
            held.append(batch.slice(a, b - a))
    if held and held[0].num_rows:
        yield pa.Table.from_batches(held).sort_by("rep")


def _pairs_of(block: pa.Table, radius: int, all_pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    _, parts, fps, sizes, _, roots = (block[c].to_numpy() for c in MEMBER[:-1])
    firsts = np.frombuffer(b"".join(block["firsts"].to_pylist()), np.uint8).reshape(len(fps), -1)
    return candidate_pairs(fps.view(np.uint64), sizes, roots, firsts, radius, all_pairs, parts)


def _together(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("shard").sortWithinPartitions("shard")


def _candidates(dealt: DataFrame, radius: int) -> DataFrame:
    """(a, b): two pairs of candidate_pairs at most for each row of each block, from MEMBER rows; a block is a shard here."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            if block.num_rows > 1:
                reps = block["rep"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(reps[x]) for x in _pairs_of(block, radius, False)], ["a", "b"])

    return _together(dealt.select(*MEMBER)).mapInArrow(pair, "a long, b long").distinct()


def _apart(dealt: DataFrame, radius: int) -> DataFrame:
    """The MEMBER rows that have a pair of candidate_pairs in their block: rows of different roots that may still be similar."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            if block.num_rows > 1:
                yield from block.take(pa.array(np.unique(np.concatenate(_pairs_of(block, radius, True))))).to_batches()

    chosen = dealt.select(*MEMBER)
    return _together(chosen).mapInArrow(rows, chosen.schema)


def _links_within(apart: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between rows of different roots, from MEMBER rows with their shingles. Every candidate pair of a
    block is compared exactly, the most alike first, unless links before it have joined the two roots."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _by_block(batches):
            i, j = _pairs_of(block, radius, True)
            sets = [x.values.to_numpy(zero_copy_only=False) for x in block["shingles"].combine_chunks()]
            reps, roots = block["rep"].to_pylist(), block["root"].to_pylist()
            up = {r: r for r in roots}

            def top(r: int) -> int:
                while up[r] != r:  # noqa: B023
                    r = up[r] = up[up[r]]  # noqa: B023
                return r

            found = []
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = top(roots[x]), top(roots[y])
                if p != q:
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if shared >= SIMILAR * (len(sets[x]) + len(sets[y]) - shared):
                        up[p] = q
                        found.append((reps[x], reps[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["a", "b"])

    return _together(apart).mapInArrow(link, "a long, b long")


def _shingle_sets(rows: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(row, shingles): the different shingles of the texts (row, text) whose row is among rows."""

    def make(batch: pa.RecordBatch) -> dict:
        sets = [np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t, width)])).view(np.int64) for t in batch.column(1).to_pylist()]
        return {"row": batch.column(0), "shingles": pa.array(sets, pa.list_(pa.int64()))}

    rows = F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    return stored(over_batches(texts.join(rows, "row", "left_semi").select("row", "text"), make, "row long, shingles array<long>"), "shingle-sets")


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of row numbers whose texts have SIMILAR of their different shingles in common; texts are (row, text)."""
    sets = _shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), texts, width)
    left = spread_join(pairs, sets.withColumnsRenamed({"row": "b", "shingles": "sb"}), ["b"], F.col("a"))
    both = spread_join(left, sets.withColumnsRenamed({"row": "a", "shingles": "sa"}), ["a"], F.col("b"), sizes=pairs.groupBy("a").agg(F.count("*").alias("n")))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", shared.alias("s"), (F.size("sa") + F.size("sb")).alias("n")).where(F.col("s") >= SIMILAR * (F.col("n") - F.col("s"))).select("a", "b")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a row number, written so that the number stays with its row."""
    return stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")


def _similar_rows(numbered: DataFrame, width: int, radius: int, views: int) -> DataFrame:
    """(row, doc_id, component): one row per row; component is the smallest row number of its group."""

    def make(batch: pa.RecordBatch) -> dict:
        fps, seen, sizes, keys, firsts = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            blocks = list(shingle_hashes(text, width))
            fps.append(majority(blocks))
            seen.append(np.array(view_fingerprints(blocks, views), np.uint64).view(np.int64))
            different = np.unique(np.concatenate([np.zeros(0, np.uint64), *blocks]))
            sizes.append(len(different))
            firsts.append(first_shingles(different))
            keys.append(xxhash.xxh3_128_digest(b" ".join(text.encode("utf-8", "surrogatepass").lower().split())))
        return {"row": batch.column(0), "doc_id": batch.column(1), "fp": pa.array(np.array(fps, np.uint64).view(np.int64)), "views": pa.array(seen, pa.list_(pa.int64())), "n": pa.array(sizes, pa.int32()), "key": pa.array(keys, pa.binary()), "firsts": pa.array(firsts, pa.binary())}

    kind = numbered.schema["doc_id"].dataType.simpleString()
    texts = numbered.select(F.col("__row").alias("row"), "doc_id", text_of(numbered).alias("text"))
    prints = stored(over_batches(texts, make, f"row long, doc_id {kind}, fp long, views array<long>, n int, key binary, firsts binary"), "view-prints")
    classes = stored(prints.groupBy("key").agg(F.min("row").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("views").alias("views"), F.first("firsts").alias("firsts")), "text-classes")
    views = classes.where("n > 0").select("rep", "fp", "n", F.explode(F.array_distinct("views")).alias("v"))
    seen = stored(views.groupBy("v").agg(F.min("rep").alias("rep"), F.count("*").alias("n")), "views")
    near = stored(fingerprint_components(seen.select(F.col("rep").alias("doc_id"), F.col("v").alias("fp"), (F.col("n") == 1).alias("lone")), VIEW_RADIUS), "view-groups")
    groups = near.select(F.col("fp").alias("v"), F.col("component_id").alias("shard"))
    bits = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    grouped = maybe_among(views, bits("v"), stored(digest_map(groups.select(bits("v").alias("d")), "d"), "views-map")).where("__maybe")  # most of the others stay where they are
    shards = stored(spread_join(grouped, groups, ["v"], F.col("rep"), sizes=seen.where("n > 1")).select("rep", "fp", "n", "shard").distinct(), "view-members")
    counts = stored(shards.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "view-shards")
    sized = spread_join(shards, counts.select("shard", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), ["shard"], F.col("rep"), sizes=counts)
    firsts = classes.select(F.col("rep").alias("__of"), "firsts")
    members = stored(sized.join(firsts, sized["rep"] == firsts["__of"]).drop("__of"), "members")
    links = stored(_verified(stored(_candidates(first_blocks(members).withColumn("root", F.col("rep")), radius), "candidates"), texts, width), "similar")
    roots = components(links)
    rooted = members.join(roots, members["rep"] == roots["node"], "left").select("shard", "fp", "n", "rep", "firsts", F.coalesce("root", "rep").alias("root"))
    apart = stored(_apart(last_blocks(stored(rooted, "rooted")), radius), "apart")
    sets = _shingle_sets(apart.select(F.col("rep").alias("row")).distinct(), texts, width)
    last = _links_within(apart.join(sets.withColumnRenamed("row", "__row"), F.col("rep") == F.col("__row")).drop("__row"), radius)
    roots = components(links.unionByName(stored(last, "similar")))
    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("key", F.coalesce("root", "rep").alias("component"))
    return spread_join(prints.select("row", "doc_id", "key"), named, ["key"], F.col("row")).select("row", "doc_id", "component")


def similar_documents(docs: DataFrame, width: int = 5, radius: int = 20, views: int = VIEWS) -> DataFrame:
    """(doc_id, component_id), one row per row of docs: groups of texts linked by a Jaccard similarity of at
    least SIMILAR of their different word shingles; component_id is the smallest doc_id of the group.

    Shingles in common at a similarity of s put two fingerprints about 64 * acos(2s / (1 + s)) / pi bits
    apart: for 0.8 some ten, and within 20 for all but some 0.03 %. Triangle bounds prune nothing at such a
    distance, so each text has several view fingerprints as well, each of the VIEW_SHINGLES shingles that come first in
    an order of all shingles. The vantage-point tree links view fingerprints within VIEW_RADIUS bits, over shards with
    their boundaries, as it does whole fingerprints in near_duplicates: similar texts have a view in common with probability s ** 3
    each, and one of eight with 0.997 for 0.8. Texts of a linked group whose whole fingerprints are within the radius, and
    whose first shingles in MINIMA orders are LIKELY equal (all but some 0.003 % at 0.8), are
    candidates, and every link is then an exact comparison. Equal texts are gathered before. One round of
    two candidates a text in each of its first_blocks() links most of a group; then every candidate pair that is still apart is compared inside
    one of the last_blocks(), which gives links that join groups and no others. Rows are sent in proportion to a group's size, but for the texts of a group
    of views that the first round hasn't linked to most of it: where these are over LAST_BLOCK, they are sent once for each LAST_BLOCK of its rows.

    Texts without a word are equal to each other, null ones too. Repeated rows are members of their own. An
    empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    found = _similar_rows(_numbered(docs), width, radius, views)
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return spread_join(found, least, ["component"], F.col("row")).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 5, radius: int = 20) -> DataFrame:
    """One row of each group of similar_documents, with all columns whatever their names: that of the smallest
    doc_id, nulls last, and of those that share it the first by row number. So of repeated rows one stays; rows
    without doc_id are grouped like any other; null, empty and blank texts are one group. Texts are compared
    whole, however long. An empty table gives an empty result."""
    numbered = _numbered(docs)
    found = stored(_similar_rows(numbered, width, radius, VIEWS), "similar-rows")
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best")).select("best.row")
    gone = stored(found.join(kept, "row", "left_anti").select(F.col("row").alias("__gone")), "near-copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return numbered.join(gone, numbered["__row"] == gone["__gone"], "left_anti").select(*(f"`{c}`" for c in docs.columns))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
