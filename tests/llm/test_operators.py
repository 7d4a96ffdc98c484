"""The text operators against brute force, other libraries, round trips and held-out labels, and their edge cases."""

import base64
import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerlake.llm.registry")

import public_tokenizers  # noqa: E402
import regex  # noqa: E402
import tiktoken  # noqa: E402

from ledgerlake.llm import bpe, chat_format, common, decontamination, graph, language_id, quality_net, quality_rules, registry, simhash_dedup, suffix_array, suffix_dedup, token_counts, warc  # noqa: E402

LONG = "word " * 30_000
#: Rows with nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own.
EDGE = [
    (1, "Some words that make a small text of no great length, twice over.", "en", "a", 1),
    (2, "Some words that make a small text of no great length, twice over.", "en", "a", 1),
    (3, "", None, None, None),
    (4, None, "en", "b", None),
    (5, LONG, "en", "b", 7),
    (5, LONG, "en", "b", 7),
    (None, "a text without an id é 日本", "fr", None, 3),
    (6, "   \n\t ", "xx", "c", 2),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, d string, fp string, marks int, start int, h int, words string, k int, n int, window string, value int"


def edge(spark, empty=False):
    return spark.createDataFrame([] if empty else [(*r, "x", "y", 1, 2, 3, "z", 4, 5, "w", 6) for r in EDGE], COLUMNS)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents")


# -- suffix arrays


def plain_suffix_order(strings):
    s = b"\xff".join(strings) + b"\xff"
    ends = [i for i, c in enumerate(s) if c == 255]

    def key(i):
        stop = next(e for e in ends if e >= i)
        return [c + 1000 for c in s[i:stop]] + [ends.index(stop)]

    order = sorted(range(len(s)), key=key)
    common_prefix = [0] * len(s)
    for a, b in zip(order, order[1:]):
        x, y = key(a), key(b)
        common_prefix[b] = next((k for k, (i, j) in enumerate(zip(x, y)) if i != j), min(len(x), len(y)))
    return order, common_prefix


def test_suffix_arrays_and_prefixes():
    rnd = random.Random(1)
    for _ in range(150):
        signs = rnd.choice([b"a", b"ab", b"abcd", bytes(range(0, 250, 7))])
        base = bytes(rnd.choice(signs) for _ in range(rnd.randint(1, 40)))
        strings = [rnd.choice([base, base[len(base) // 2 :] + base, bytes(rnd.choice(signs) for _ in range(rnd.randint(1, 30)))]) for _ in range(rnd.randint(1, 5))]
        sizes = np.array([len(x) for x in strings])
        s = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
        order = suffix_array.suffix_array(s)
        expected, prefixes = plain_suffix_order(strings)
        assert order.tolist() == expected
        assert suffix_array.permuted_common_prefixes(s, order, np.cumsum(sizes + 1) - 1).tolist() == prefixes


def plain_repeats(texts, length):
    seen = Counter(b[i : i + length] for _, t in texts for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for key, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        out.append((key, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def repeats_of(df, length, hot):
    prints, cuts = suffix_dedup.repeats(df, length, hot)
    got = prints.join(cuts.drop("kept"), "d", "left").select("doc_id", "n_bytes", "spans", F.coalesce("kept_sha256", "sha256").alias("k")).collect()
    return sorted([(r[0], r[1], sum(s["stop"] - s["start"] for s in r[2] or []), len(r[2] or []), r[3]) for r in got], key=str)


@pytest.mark.parametrize("hot", [1 << 23, 60])
def test_repeats_against_counting(spark, hot):
    rnd = random.Random(3)
    for length in (8, 40):
        bases = ["".join(rnd.choice("abé d") for _ in range(rnd.randint(5, 120))) for _ in range(4)]
        texts = [(1, None), (2, ""), (None, "aé" * 60), (3, "a" * (length + 1))]
        texts += [(k, "".join(rnd.choice([*bases, bases[0][3:40], "".join(rnd.choice("abcdefgé ") for _ in range(20))]) for _ in range(rnd.randint(1, 4)))) for k in range(4, 40)]
        texts += texts[-2:]
        assert repeats_of(spark.createDataFrame(texts, "doc_id long, text string"), length, hot) == plain_repeats(texts, length)


def test_repeats_edges(spark):
    got = suffix_dedup.without_repeats(edge(spark))
    assert got.columns == edge(spark).columns and got.count() == len(EDGE)
    assert {r["text"] for r in got.where("doc_id = 5").collect()} == {""} and {r["n_chars"] for r in got.where("doc_id = 5").collect()} == {0}
    assert suffix_dedup.repeated_spans(edge(spark, empty=True)).count() == 0


# -- near copies


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    expected = plain_components(pairs, {x for p in pairs if p[0] != p[1] for x in p})
    assert got == expected
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def near_prints(n, seed, flips):
    r = np.random.default_rng(seed)
    base = r.integers(0, 1 << 63, n // 4, dtype=np.uint64)
    out = [base]
    for _ in range(3):
        x = base.copy()
        for _ in range(flips):
            x ^= np.uint64(1) << r.integers(0, 64, len(x), dtype=np.uint64)
        out.append(x)
    return np.unique(np.concatenate(out))


@pytest.mark.parametrize(("n", "radius"), [(400, 2), (3000, 2), (4000, 12)])
def test_links_of_fingerprints(n, radius):
    fps = near_prints(n, radius, 2 if radius == 2 else 7)
    near = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius).tolist() if j < i]
    expected = plain_components(near, range(len(fps)))
    got = simhash_dedup.link_groups(fps, radius)
    assert all((got[i] == got[j]) == (expected[i] == expected[j]) for i, j in [*near, *((i, (i * 7 + 1) % len(fps)) for i in range(len(fps)))])


def test_shards_of_fingerprints(spark, monkeypatch):
    """With shards of sixty-four fingerprints, boundaries are many and no link is lost."""
    monkeypatch.setattr(simhash_dedup, "SHARD", 64)
    monkeypatch.setattr(simhash_dedup.upper_tree, "__defaults__", (64,))
    fps = near_prints(2000, 5, 1)
    prints = spark.createDataFrame([(k, int(x)) for k, x in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    near = [(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2).tolist() if j < i]
    expected = plain_components(near, range(len(fps)))
    got = {r["fp"]: r["component_id"] for r in simhash_dedup.fingerprint_components(prints, 2).collect()}
    assert all(got[int(x)] == expected[k] for k, x in enumerate(fps.view(np.int64)))


def test_near_copies_are_dropped_and_others_kept(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    base = [[rnd.choice(words) for _ in range(200)] for _ in range(20)]
    texts = []
    for k, w in enumerate(base):
        texts.append((k, " ".join(w)))
        for c in range(1, 4):
            changed = w.copy()
            changed[50 * c] = "changed"
            texts.append((100 * c + k, " ".join(changed)))
        texts.append((1000 + k, " ".join(w)))
    kept = simhash_dedup.drop_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_copies_are_those_of_four_fifths(spark):
    """Planted pairs at similarities around 0.8: links are those of 0.8 and more, and no pair below is linked."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    texts, expected = [], {}
    for k in range(240):
        aim = (0.65, 0.75, 0.8, 0.85)[k % 4]
        w = [word() for _ in range(300)]
        other = [*w]
        at = len(w)
        while jaccard(" ".join(w), " ".join([*w[:at], *other[at:]])) > aim + 0.01:
            at -= 1
            other[at] = word()
        pair = " ".join(w), " ".join([*w[:at], *other[at:]])
        texts += [(2 * k, pair[0]), (2 * k + 1, pair[1])]
        expected[k] = jaccard(*pair)
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    linked = {k for k in expected if got[2 * k + 1] == got[2 * k]}
    due = {k for k, s in expected.items() if s >= 0.8}
    assert 100 < len(due) < 140 and linked <= due and len(due - linked) <= 2


def test_one_full_text_of_repeated_and_unnumbered_rows_stays(spark):
    rnd = random.Random(13)
    a, b, c, d = (" ".join("".join(rnd.choice("abcdefghij") for _ in range(8)) for _ in range(60)) for _ in range(4))
    given = spark.createDataFrame([(7, a), (7, a), (None, b), (None, b), (9, c), (None, c), (None, c), (3, d)], "doc_id long, text string").repartition(3)
    once = simhash_dedup.drop_near_duplicates(given)
    assert rows(once) == sorted([(7, a), (None, b), (9, c), (3, d)], key=str)
    assert rows(suffix_dedup.without_repeats(once, 200)) == rows(once)


def test_a_shard_in_blocks_is_bounded_and_keeps_every_pair(spark):
    fps = near_prints(240, 21, 7).view(np.int64).tolist()
    rows_of = [(1, 20, k, k, x, 8) for k, x in enumerate(fps)] + [(2, 20, 1000 + k, 1000 + k, x, 1) for k, x in enumerate(fps[:20])]
    sized = spark.createDataFrame(rows_of, "shard long, n int, rep long, root long, fp long, parts int").withColumn("firsts", F.lit(b"same"))
    whole = sized.withColumn("part", F.lit(0)).drop("parts")
    blocks = simhash_dedup.in_blocks(sized)
    assert max(r["count"] for r in blocks.groupBy("shard").count().collect()) < 110
    reps = lambda df: {r["rep"] for r in df.collect()}
    due = reps(simhash_dedup._apart(whole, 20))
    assert len(due) > 200 and reps(simhash_dedup._apart(blocks, 20)) == due
    same = lambda df: df.withColumn("shingles", F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))
    links = [graph.components(simhash_dedup._links_within(same(df), 20)) for df in (whole, blocks)]
    assert rows(links[0]) == rows(links[1]) and links[0].count() > 200
    few = simhash_dedup._candidates(blocks, 20)
    assert few.count() <= 2 * blocks.count() and few.where("a >= b").isEmpty()


def test_candidates_of_the_last_round_are_all(spark):
    fps = near_prints(300, 9, 7)
    sizes, roots = np.arange(len(fps)) % 5 + 20, np.arange(len(fps)) % 7
    fit = lambda i, j: (int(fps[i]) ^ int(fps[j])).bit_count() <= 20 and roots[i] != roots[j] and min(sizes[i], sizes[j]) >= 0.8 * max(sizes[i], sizes[j])
    firsts = np.random.default_rng(3).integers(0, 2, (len(fps), 10), dtype=np.uint8)
    firsts[::3] = 0
    alike = lambda i, j: int((firsts[i] == firsts[j]).sum()) >= 7
    due = {(i, j) for j in range(len(fps)) for i in range(j) if fit(i, j) and alike(i, j)}
    assert set(zip(*(x.tolist() for x in simhash_dedup.candidate_pairs(fps, sizes, roots, firsts, 20, True)))) == due
    few = set(zip(*(x.tolist() for x in simhash_dedup.candidate_pairs(fps, sizes, roots, firsts, 20, False))))
    assert few <= due and {j for _, j in few} == {j for _, j in due} and max(Counter(j for _, j in few).values()) <= 2


def test_first_shingles_estimate_the_similarity():
    r = np.random.default_rng(4)
    for n, shared in ((300, 0.8), (5000, 0.8), (300, 0.5), (40, 1.0)):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        k = round(n * 2 * shared / (1 + shared))
        b = np.concatenate((a[:k], r.integers(0, 1 << 63, n - k, dtype=np.uint64)))
        x, y = (np.frombuffer(simhash_dedup.first_shingles(v), np.uint8) for v in (a, b))
        assert abs((x == y).mean() - shared) < 0.11


def test_near_duplicates_edges(spark, docs):
    found = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_duplicates(edge(spark)).collect()}
    by = {d: (f, c) for d, f, c in found}
    assert by[1] == (by[2][0], 1) and by[2][1] == 1 and by[3] == ("0" * 16, 3) and by[4][1] == by[6][1] == 3
    assert simhash_dedup.near_duplicates(edge(spark)).count() == len(EDGE)
    assert simhash_dedup.near_duplicates(edge(spark, empty=True)).count() == simhash_dedup.similar_documents(edge(spark, empty=True)).count() == 0
    assert simhash_dedup.drop_near_duplicates(edge(spark)).columns == edge(spark).columns


# -- decontamination


def plain_contamination(texts, items, least=0.8):
    split = lambda s: regex.findall(r"[\p{L}\p{N}]+", (s or "").lower())
    shingles = lambda w: Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([" ".join(w)] if w else [])
    out = {}
    for i, s in items:
        mine, n = shingles(split(s)), len(split(s))
        for d, x in texts:
            w = split(x)
            if not n or not set(mine) & set(shingles(w) if n >= 5 else Counter(" ".join(w[k : k + n]) for k in range(len(w)))):
                continue
            for a in range(max(1, len(w) - n + 1)):
                theirs = shingles(w[a : a + n])
                if (q := sum((mine & theirs).values()) / sum((mine | theirs).values())) >= least:
                    out[d, i] = max(q, out.get((d, i), 0))
    return out


@pytest.mark.parametrize("most", [400_000, 0])
def test_contamination_against_all_windows(spark, docs, sf, most):
    items = common.table(spark, sf, "benchmark")
    known = [(r["item_id"], r["text"]) for r in items.collect()]
    words = known[0][1].split()
    planted = [(-1, "before " + " ".join(words) + " after"), (-2, "x " + " ".join([*words[:-1], "other"])), (-3, known[1][1].upper()), (-4, " ".join(words[: len(words) // 2]))]
    extra = [(-10, "two words"), (-11, ""), (-12, None)]
    all_docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*planted, (-5, "these two words too")], "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contamination(all_docs, items.unionByName(spark.createDataFrame(extra, "item_id long, text string")), most=most).collect()}
    expected = plain_contamination([(r["doc_id"], r["text"]) for r in all_docs.collect()], known + extra)
    assert got == pytest.approx(expected) and {(-1, 0), (-2, 0), (-3, 1), (-5, -10)} <= set(got) and (-4, 0) not in got


def test_contamination_of_reordered_passages(spark):
    rnd = random.Random(14)
    words = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    item, twin = words(50), words(50)
    moved = [("swapped", item[25:] + item[:25]), ("last ten first", item[40:] + item[:40]), ("sentence", item[:10] + item[18:30] + item[10:18] + item[30:]), ("half", item[:25] + words(25)), ("other", twin[20:] + item[:20])]
    texts = [(k, " ".join(words(30) + w + words(30))) for k, (_, w) in enumerate(moved)]
    items = [(1, " ".join(item)), (2, " ".join(twin))]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == pytest.approx(plain_contamination(texts, items)) and {(0, 1), (1, 1)} <= set(got) and got[0, 1] == pytest.approx(42 / 50)


def test_contamination_edges(spark, docs, sf):
    items = common.table(spark, sf, "benchmark")
    assert decontamination.contamination(edge(spark), items).count() == 0
    assert decontamination.contamination(edge(spark, empty=True), items).count() == 0
    assert decontamination.contamination(docs, items.where("false")).count() == 0
    assert decontamination.drop_contaminated(edge(spark), items).count() == len(EDGE)


def test_block_index_reaches_the_radius():
    bounds = decontamination.block_bounds()
    assert sum(b for _, b in bounds) == 64
    rnd = random.Random(6)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for k in rnd.sample(range(64), decontamination.RADIUS):
            b ^= 1 << k
        assert any(((a ^ b) >> s & ((1 << n) - 1)).bit_count() <= decontamination.RADIUS // decontamination.BLOCKS for s, n in bounds)


# -- tokens


HARD = ["", " ", "a" * 5000, " " * 4000 + "x", "x" + " " * 40_000, "don't  stop\n\n\n it's <|endoftext|> 日本語 é", LONG, "word\t" * 9000, "x " * 20_000 + "\n" * 3000 + "y"]


def test_encoding_is_the_library_s():
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    for text in HARD:
        ids = bpe.encode(enc, text)
        assert ids.tolist() == enc.encode_ordinary(text)
        assert bpe.decode(enc, ids) == text.encode()


def test_encoded_edges(spark):
    got = bpe.encoded(edge(spark), public_tokenizers.path(bpe.RANKS)).collect()
    assert len(got) == len(EDGE) and sorted(r["decoded"] for r in got) == sorted((r[1] or "").encode() for r in EDGE)
    assert isinstance(bpe.encoding(public_tokenizers.path(bpe.RANKS)), tiktoken.Encoding)
    assert bpe.encoded(edge(spark, empty=True), public_tokenizers.path(bpe.RANKS)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_and_cache(spark, tmp_path, name):
    path, cache = public_tokenizers.path(name), str(tmp_path / "cache")
    df = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").unionByName(edge(spark).select("doc_id", "text"))
    texts = [r["text"] or "" for r in df.collect()]
    if name.endswith(".model"):
        import sentencepiece

        expected = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        from tokenizers import Tokenizer

        expected = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = token_counts.token_counts(df, path, cache)
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(expected)
    held = spark.read.parquet(cache).count()
    assert held == len(set(texts))
    token_counts.add_missing(df.unionByName(spark.createDataFrame([(99, "new")], "doc_id long, text string")), path, cache)
    assert spark.read.parquet(cache).count() == held + 1
    assert token_counts.token_counts(df.where("false"), path, cache).count() == 0


# -- learned operators


@pytest.fixture(scope="module")
def larger(spark):
    return "/root/testdata/sf0.01"


def area(score, label):
    order = np.argsort(score)
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_quality_scores_held_out(spark, larger):
    got = quality_net.op1_quality_net(spark, larger).join(common.table(spark, larger, "labels"), "doc_id").where("held_out").toPandas()
    assert area(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.8
    assert ((got["score"] >= quality_net.CUT) == got["predicted"]).all()


def test_quality_scores_edges(spark):
    got = quality_net.quality_scores(edge(spark), quality_net.ByteNet())
    assert got.count() == len(EDGE) and all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality_net.quality_scores(edge(spark, empty=True), quality_net.ByteNet()).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_net.learn(edge(spark), labels, F.lit(True)).p["b"].tolist() == [0.0]


def test_rule_statistics_and_verdicts(spark, larger):
    got = quality_rules.op2_quality_rules(spark, larger)
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, larger, "documents").collect()}
    found = {r["doc_id"]: r for r in got.collect()}
    assert found.keys() == texts.keys()
    for k, t in texts.items():
        w = regex.findall(r"[^\x20\x09-\x0D]+", t or "")
        triples = Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
        r = found[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(regex.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
    marked = got.join(common.table(spark, larger, "labels"), "doc_id").toPandas()
    assert marked[marked["quality"] == 1]["kept"].mean() > marked[marked["quality"] == 0]["kept"].mean()


def test_rule_edges(spark):
    assert quality_rules.learn(edge(spark), spark.createDataFrame([], "doc_id long, quality int")) == []
    got = quality_rules.quality_verdicts(edge(spark), [])
    assert got.count() == len(EDGE) and {r["n_words"] for r in got.where("doc_id in (3, 4, 6)").collect()} == {0}
    x = {c: np.array([10, 10, 10, 10, 10, 10]) for c in quality_rules.COUNTS} | {"n_symbols": np.array([50, 60, 70, 0, 1, 0])}
    rules = quality_rules.learn_rules({k: np.tile(v, 10) for k, v in x.items()}, np.tile(np.array([1, 1, 1, 0, 0, 0], bool), 10))
    assert len(rules) == 1 and rules[0][0].feature == "symbols_per_word" and rules[0][0].at_least


def test_language_held_out(spark, larger):
    got = language_id.op8_language_id(spark, larger)
    marked = got.join(common.table(spark, larger, "documents").select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and text rlike '[a-z]{3}'").toPandas()
    assert (marked["lang"] == marked["lang_pred"]).mean() > 0.9 and got.where("score < 0 or score > 1").isEmpty()


def test_text_of_no_language_is_rejected_and_short_text_is_kept():
    sql = "select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet' where lang is not null and length(text) between 40 and 20000 and regexp_matches(text, '[a-z]{3}') order by doc_id"
    given = duckdb.sql(sql).fetchall()
    model = language_id.fit([t for d, t, _ in given if d % 4], [k for d, _, k in given if d % 4])

    def kept(texts):
        cos = language_id.vectors(texts, model.idf) @ model.matrix.T
        return cos.max(axis=1) >= model.limit(cos.argmax(axis=1), texts)

    rnd = random.Random(15)
    letters = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    assert not kept([letters(n) for n in (20, 200, 1000) for _ in range(20)]).any()
    assert not kept([base64.b64encode(rnd.randbytes(n)).decode() for n in (300, 3000) for _ in range(20)]).any()
    for lang in sorted(set(model.langs)):
        for n in (40, 80, 160):
            assert kept([t[:n] for d, t, k in given if d % 4 == 0 and k == lang]).mean() >= 0.95


def test_language_edges(spark, docs):
    model = language_id.learn(docs, F.lit(True))
    by = {r["doc_id"]: r for r in language_id.identify(edge(spark), model).collect()}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 and by[k]["rejected"] for k in (3, 4, 6))
    none = language_id.learn(docs.where("false"), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(edge(spark), none).collect()} == {"und"}
    assert language_id.identify(edge(spark, empty=True), model).count() == 0 and language_id.keep_identified(edge(spark)).columns == edge(spark).columns


# -- chats and archives


def duck(folder, sql):
    con = duckdb.connect()
    for t in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    return sorted((tuple(x[names.index(c)] for c in sorted(names)) for x in r.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert rows(df.select(*sorted(df.columns))) == duck(sf, registry.ORACLE[name])


def test_chat_edges(spark):
    said = [(1, 0, "system", "be <|turn|> kind"), (1, 1, "user", None), (1, 2, "assistant", "<\\|text|> " * 900), (1, 3, "user", "again"), (1, 4, "assistant", ""), (2, None, None, "x"), (None, 0, "assistant", "no id"), (2, None, None, "x")]
    df = spark.createDataFrame([(*s, "c", 1) for s in said], "conv_id long, turn long, role string, text string, k string, l int")
    windows = chat_format.format_windows(df, budget=256, history=64)
    read = chat_format.read_windows(windows).orderBy("conv_id", "window").collect()
    turns = {}
    for r in read:
        turns.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
    assert turns == {1: [(r, t or "") for c, _, r, t in said if c == 1], 2: [("", "x"), ("", "x")], None: [("assistant", "no id")]}
    assert sorted(x for r in read for x in r["learned"]) == sorted(["<\\|text|> " * 900, "", "no id"])
    assert len([r for r in read if r["conv_id"] == 1]) > 1
    assert chat_format.format_windows(df.where("false")).count() == 0


def test_archives_edges(spark, tmp_path):
    html = [(1, "http://a", "<p>é</p>"), (2, None, None), (3, "http://b\r\nX: y", "<p>é</p>"), (4, "u", ""), (None, "u", "<p>é</p>"), (1, "http://a", "<p>é</p>"), (5, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*h, "s", 1) for h in html], "page_id long, url string, html string, sha1 string, size int")
    warc.write_archives(df, str(tmp_path / "w"))
    got = sorted([(r["page_id"], r["record_type"], r["refers_to"], r["payload"]) for r in warc.read_archives(spark, str(tmp_path / "w")).collect()], key=str)
    p = "<p>é</p>".encode()
    expected = [(1, "response", None, p), (1, "response", None, p), (2, "response", None, b""), (3, "revisit", 1, None), (4, "revisit", 2, None), (5, "response", None, b"x" * 300_000), (None, "response", None, p)]
    assert [(a, b, c, bytes(x) if x is not None else None) for a, b, c, x in got] == sorted(expected, key=str)
    warc.write_archives(df.where("false"), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


# -- pipeline


def test_pipeline(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    df = common.table(spark, sf, "documents")
    columns = df.columns
    for name, stage in pipeline.STAGES:
        before, df = df, common.stored(stage(spark, df, sf), name)
        assert name == "bpe" or df.columns == columns
        assert df.join(before, "doc_id", "left_anti").isEmpty() and df.count() > 0.7 * before.count()
    assert rows(df) == rows(pipeline.run(spark, sf))


# -- joins on hot keys


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_is_the_plain_join(spark, how):
    made = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).cast("int").alias("k"), F.lit("a").alias("m"))
    known = spark.range(600).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("m"), (F.col("id") * 2).alias("v"))
    got = common.spread_join(made, known, ["k", "m"], F.col("id"), how)
    expected = made.join(known, ["k", "m"], how)
    assert got.columns == expected.columns and rows(got) == rows(expected)
    assert common.spread_join(made.where("false"), known, ["k", "m"], F.col("id"), how).count() == 0
