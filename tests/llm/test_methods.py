"""The text operators' methods: each against a plain form of the same calculation, on skewed, reordered and hostile inputs."""

import hashlib
import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("ledgerlake.llm.registry")

import public_tokenizers  # noqa: E402
import xxhash  # noqa: E402

from ledgerlake.llm import bpe, chat_format, common, decontamination, language_id, quality_net, quality_rules, simhash_dedup, suffix_array, suffix_dedup, token_counts, warc  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, "one small text that is here twice", "en", "a", 1), (2, "one small text that is here twice", "en", "a", 1), (3, "", None, None, None), (4, None, "en", "b", None), (5, "word " * 30_000, "en", "b", 7), (5, "word " * 30_000, "en", "b", 7), (None, "a text without an id é 日本", "fr", None, 3), (6, " \n\t ", "xx", "c", 2)]


def word(rnd, n=7):
    return "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))


# -- op1


def test_pooling_is_the_full_convolution(monkeypatch):
    monkeypatch.setattr(quality_net, "BLOCK", 64)
    net, rnd = quality_net.ByteNet(5), random.Random(1)
    w, v, f = quality_net.WIDTH, quality_net.STRIDE, quality_net.FILTERS
    for n in (0, 1, 15, 16, 17, 24, 63, 64, 65, 200, 1000):
        data = rnd.randbytes(n)
        chunks = max(1, -(-max(0, n - w) // v) + 1)
        padded = data + bytes((chunks - 1) * v + w - n)
        plain = [[float(net.p["e"][list(padded[k * v : k * v + w])].reshape(-1) @ net.p["w"][:, j]) for j in range(f)] for k in range(chunks)]
        assert net.pooled(data)[0] == pytest.approx(np.max(plain, axis=0) + net.p["c"], abs=1e-4)
        best, spot = net.pooled(data, True)
        assert spot.tolist() == [v * int(np.argmax([row[j] for row in plain])) for j in range(f)]


def test_training_lowers_the_loss_and_is_repeatable():
    rnd = random.Random(2)
    texts = [(b"good words in rows. " if k % 2 else b"$$ ### @@ |||| ") * rnd.randint(1, 40) + rnd.randbytes(20) for k in range(60)]
    y = np.array([k % 2 for k in range(60)], np.float32)
    loss = lambda net: float(-np.mean(np.log(np.where(y == 1, net.scores(texts), 1 - net.scores(texts)) + 1e-9)))
    trained, again = quality_net.ByteNet().fit(texts, y), quality_net.ByteNet().fit(texts, y)
    assert loss(trained) < 0.2 * loss(quality_net.ByteNet()) and all((trained.p[k] == again.p[k]).all() for k in trained.p)


# -- op2


def test_rules_hold_on_rows_they_were_not_learned_from(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", x) for x in ("documents", "labels"))
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 1
    rules = quality_rules.learn(docs, labels.where(odd))
    got = quality_rules.quality_verdicts(docs, rules).join(labels.where(~odd), "doc_id").toPandas()
    assert got[got["quality"] == 1]["kept"].mean() > 0.85 and got[got["quality"] == 0]["kept"].mean() < 0.15


# -- op3


def test_near_duplicates_against_all_pairs(spark, sf):
    rows = common.table(spark, sf, "documents").select("doc_id", "text").collect()

    def plain(text):
        words = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).encode().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
        votes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in votes) * 2 > len(votes))

    fps = {r["doc_id"]: plain(r["text"]) for r in rows}
    root = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and root[b] > root[a]:
                    root[b], changed = root[a], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.op3_simhash_dedup(spark, sf).collect()}
    assert got == {d: (f"{x:016x}", root[d]) for d, x in fps.items()} and len(set(root.values())) < len(root)


def test_candidates_come_through_the_tree(spark, monkeypatch):
    """Without links of view fingerprints there are no candidates, so there are no groups but of equal texts."""
    rnd = random.Random(3)
    base = [word(rnd) for _ in range(120)]
    texts = [(1, " ".join(base)), (2, " ".join([*base[:-2], "x", "y"])), (3, " ".join(base))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["component_id"] for r in simhash_dedup.similar_documents(df).collect()} == {1}
    apart = lambda prints, radius: prints.select("fp", F.col("doc_id").alias("component_id")).where("false")  # noqa: E731, ARG005
    monkeypatch.setattr(simhash_dedup, "fingerprint_components", apart)
    assert {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_documents(df).collect()} == {1: 1, 2: 2, 3: 1}


# -- op4


def test_long_texts_of_any_white_space_encode_as_the_library_does():
    enc, rnd = bpe.encoding(public_tokenizers.path(bpe.RANKS)), random.Random(4)
    kinds = ["\n\x1c", "\x1c\x1d\x1e\x1f ", " \t\n", "　\x85", "   a", "\x85 ​", "。漢字かな、 a", ".'s t", "᠎ ﻿"]
    for _ in range(120):
        parts = ["word " * rnd.randint(1, 9000), "".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randint(1, 3000))), "漢字かな。" * rnd.randint(1, 4000), rnd.choice(" \x1c　\n") * rnd.randint(1, 2000)]
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(2, 6)))
        assert bpe.encode(enc, text).tolist() == enc.encode_ordinary(text)
    assert max(map(len, bpe.pieces("漢字かな。" * 40_000))) <= 2 * bpe.PIECE
    assert "".join(bpe.pieces("漢字かな。 word" * 9000)) == "漢字かな。 word" * 9000


# -- op5


def test_suffix_arrays_of_many_names(monkeypatch):
    """Blocks whose leftmost-smaller substrings have thousands of names, in ranges of few symbols, with runs and periods."""
    monkeypatch.setattr(suffix_array, "RANGE", 32)
    monkeypatch.setattr(suffix_array, "ROUNDS", 3)
    rnd = random.Random(5)
    counted = b"".join(b"%05d" % k for k in range(1500))
    for strings in ([counted], [counted[:3000], counted[1000:5000], b"z" * 400, b"zy" * 300], [b"word " * 300 + rnd.randbytes(200).replace(b"\xff", b"") for _ in range(4)], [bytes(rnd.choices(range(200), k=50)) * 3 for _ in range(20)]):
        s = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8) + np.uint8(1)
        ends = np.flatnonzero(s == 0)
        key = lambda i: (bytes(s[i : ends[np.searchsorted(ends, i)]]), int(np.searchsorted(ends, i)))  # noqa: B023, E731
        assert suffix_array.suffix_array(s).tolist() == sorted(range(len(s)), key=key)


@pytest.mark.parametrize("hot", [1 << 23, 200])
def test_repeats_of_a_passage_in_hundreds_of_texts(spark, hot):
    rnd, length = random.Random(6), 40
    passage, other = word(rnd, 60), word(rnd, 45)
    texts = [(k, word(rnd, rnd.randint(0, 30)) + passage[k % 7 :] + (other if k % 5 == 0 else "") + word(rnd, rnd.randint(0, 9))) for k in range(500)]
    texts += [(1000 + k, word(rnd, 50) if k % 3 else "é" * 30) for k in range(60)] + [texts[0]] * 150
    seen = Counter(b[i : i + length] for _, t in texts for b in [t.encode()] for i in range(len(b) - length + 1))
    expected = []
    for k, t in texts:
        b, gone = t.encode(), set()
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone.update(range(i, i + length))
        expected.append((k, len(b), len(gone), hashlib.sha256(bytes(c for i, c in enumerate(b) if i not in gone)).hexdigest()))
    found = suffix_dedup.repeats(spark.createDataFrame(texts, "doc_id long, text string"), length, hot)
    got = found[0].join(found[1].drop("kept"), "d", "left").select("doc_id", "n_bytes", "spans", F.coalesce("kept_sha256", "sha256")).collect()
    assert sorted((r[0], r[1], sum(s["stop"] - s["start"] for s in r[2] or []), r[3]) for r in got) == sorted(expected)


# -- op6


def test_recall_of_windows_at_the_threshold(spark):
    """Items with changed words, so that their windows' similarity lies between 0.8 and 0.9: at least 0.98 are reported."""
    rnd = random.Random(7)
    items, texts, due = [], [], set()
    for k in range(300):
        words = [word(rnd) for _ in range(40 + k % 40)]
        items.append((k, " ".join(words)))
        shingles = len(words) - 4
        # the last `gone` words differ: 2 * gone shingles are not shared, one in either text
        gone = rnd.randint(max(1, math.ceil(shingles * 0.053)), math.floor(shingles / 9))
        texts.append((k, " ".join([word(rnd) for _ in range(25)] + words[:-gone] + [word(rnd) for _ in range(gone + 20)])))
        if 0.8 <= (shingles - gone) / (shingles + gone) <= 0.9:
            due.add((k, k))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(due) > 250 and len(got & due) >= 0.98 * len(due) and all(a == b for a, b in got)


def test_a_shingle_of_many_items_and_texts(spark):
    rnd = random.Random(8)
    common_words = "the same five words again and again".split()
    items = [(k, " ".join(common_words + [word(rnd) for _ in range(20 + k % 30)])) for k in range(60)]
    texts = [(k, " ".join(common_words * 3 + [word(rnd) for _ in range(30)])) for k in range(400)] + [(1000 + k, "start " + t + " stop") for k, t in items]
    df, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (400_000, 0):
        assert sorted((r["doc_id"], r["item_id"]) for r in decontamination.contamination(df, known, most=most).collect()) == [(1000 + k, k) for k in range(60)]


# -- op8


def test_cosines_are_those_of_plain_counting():
    texts = ["The cat sat on the mat, 12 times.", "El gato se sentó en la alfombra", "Le chat s'est assis", "", "日本語", "a"]
    idf = np.linspace(0.5, 2, language_id.DIMS).astype(np.float32)

    def plain(text):
        data = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()).lower() + b" "
        grams = Counter()
        for i in range(len(data) - 2):
            a, b, c = data[i : i + 3]
            if (b, c) != (32, 32):
                grams[((a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) & 0xFFFFFFFF) >> 20] += 1
        v = {g: math.log1p(n) * float(idf[g]) for g, n in grams.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / size for g, x in v.items()}

    made = language_id.vectors(texts, idf)
    for k, t in enumerate(texts):
        assert {g: float(made[k, g]) for g in np.flatnonzero(made[k])} == pytest.approx(plain(t), abs=1e-5)
    model = language_id.Centroids(idf, made[:3], ["en", "es", "fr"], np.zeros((3, len(language_id.CUTS))))
    best, score = language_id.nearest(texts, model, rows=2)
    dots = [[sum(x * float(made[c, g]) for g, x in plain(t).items()) for c in range(3)] for t in texts]
    assert score == pytest.approx([max(d) for d in dots], abs=1e-5) and best[:3].tolist() == [0, 1, 2]


def test_foreign_text_is_rejected_and_own_text_is_not(spark):
    docs = common.table(spark, FOLDER, "documents")
    found = language_id.op8_language_id(spark, FOLDER).join(docs.where("lang is not null and text rlike '[a-z]{3}'").select("doc_id"), "doc_id").where("held_out").toPandas()
    assert found["rejected"].mean() < 0.02
    foreign = ["これは日本語の文章です。とても長い文章なので、よく読んでください。" * 5, "Это русский текст о погоде, дорогах и людях в большом городе. " * 5, "xqz vbrk wjjt pfgh zzkq mnbv qwrt ghjk plkm " * 8, "0x9f3c 77ab ffee 01d2 c0de beef " * 20 + "zz"]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(foreign)], "doc_id long, text string, lang string")
    both = language_id.identify(df, language_id.learn(docs, F.lit(True)))
    assert [r["rejected"] for r in both.orderBy("doc_id").collect()] == [True] * len(foreign)
    kept = language_id.keep_identified(docs.select("doc_id", "text", "lang").unionByName(df.withColumn("doc_id", -1 - F.col("doc_id"))))
    assert kept.where("doc_id < 0").isEmpty() and kept.count() > 0.9 * docs.count()


# -- op9


def test_windows_keep_their_budget_and_the_system_turn(spark):
    rnd = random.Random(9)
    said = []
    for c in range(60):
        if c % 3:
            said.append((c, 0, "system", "rules " * rnd.randint(1, 30)))
        said += [(c, t, "user" if t % 2 else "assistant", "word " * rnd.randint(0, 70)) for t in range(1, rnd.randint(2, 60))]
    windows = chat_format.format_windows(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"), budget=300, history=60)
    cost = lambda text: -(-len(text.encode()) // 4) + chat_format.OVERHEAD
    for w in windows.collect():
        turns = [x.split(chat_format.TEXT) for x in w["formatted"].split(chat_format.TURN)[1:]]
        texts = [(role, text.removesuffix(chat_format.END)) for role, text in turns]
        assert sum(cost(t) for _, t in texts) <= 300 or len(texts) - w["n_context"] == 1
        if w["conv_id"] % 3:
            assert [r for r, _ in texts].count("system") == 1


def test_estimated_tokens_against_the_encoder(spark):
    enc = bpe.encoding(public_tokenizers.path(bpe.RANKS))
    rows = common.table(spark, FOLDER, "conversations").where("text is not null").select("text", (chat_format.tokens(F.col("text")) - chat_format.OVERHEAD).alias("n")).collect()
    real = sum(len(enc.encode_ordinary(r["text"])) for r in rows)
    assert 0.6 < sum(r["n"] for r in rows) / real < 1.7


# -- op10


def test_archives_are_bounded_and_start_with_a_dictionary_and_a_description(spark, tmp_path):
    rnd = random.Random(10)
    df = spark.createDataFrame([(k, f"http://a/{k}", word(rnd, 4000)) for k in range(200)], "page_id long, url string, html string").repartition(2)
    warc.write_archives(df, str(tmp_path / "w"), size=50_000)
    files = sorted((tmp_path / "w").glob("part-*"))
    full = [f.read_bytes() for f in files if f.stat().st_size]
    assert len(full) > 5 and max(map(len, full)) < 50_000 + warc.DICT_BYTES + 5000
    for data in full:
        heads = [warc.parse_record(x)[0]["WARC-Type"] for x in warc.frames(data)]
        assert data[:4] == warc.DICT_MAGIC and heads[0] == "warcinfo" and set(heads[1:]) == {"response"}
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 200


# -- what they share


def test_a_cluster_needs_a_shared_folder():
    settings = {"spark.master": "spark://host:7077", "spark.app.id": "x"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, default=None: settings.get(k, default)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(session, "t")
    settings["spark.checkpoint.dir"] = "/shared"
    assert common.shared_folder(session, "t").startswith("/shared/ledgerlake/t-")


def test_scratch_tables_go_and_settings_stay(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    with common.scratch(spark):
        held = common.stored(spark.range(5), "t")
        path = held.inputFiles()[0]
        out = str(tmp_path / "out")
        common.over_batches(held, lambda b: {"id": b.column(0)}, "id long").write.parquet(out)
    import os
    from urllib.parse import urlparse

    assert not os.path.exists(urlparse(path).path) and spark.read.parquet(out).count() == 5
    token_counts.token_counts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), public_tokenizers.path(token_counts.MODEL), str(tmp_path / "cache")).collect()
    assert before == {k: spark.conf.get(k) for k in before}


@pytest.mark.parametrize("rows", [EDGE, []])
def test_pipeline_on_edge_rows(spark, sf, rows):
    """Texts learned from make the language stage let the edge rows' language pass; without any, nothing passes."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame(rows, COLUMNS)
    if rows:
        docs = docs.unionByName(common.table(spark, sf, "documents").where("doc_id >= 10").select(docs.columns))
    for name, stage in pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf), name)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    left = {r["doc_id"] for r in docs.collect()}
    assert not left & {3, 4, 6} and (not rows or len(left) > 50) and docs.count() == docs.distinct().count()


def test_rows_without_doc_id_link_others(spark):
    """b and b ^ 15 are linked through b ^ 3, which only rows without doc_id have; so is a component of such rows alone, and one of them in the middle."""
    base = 0x0F0F_1234_5678_9ABC
    prints = [(1, base), (None, base ^ 3), (5, base ^ 15), (None, ~base), (None, ~base ^ 1), (7, base ^ 0xFF00), (None, base ^ 3), (9, 0)]
    rows = [(d, f - (1 << 64) if f >= 1 << 63 else f) for d, f in ((d, f & (2**64 - 1)) for d, f in prints)]
    got = {r.fp: r.component_id for r in simhash_dedup.fingerprint_components(spark.createDataFrame(rows, "doc_id long, fp long"), 2).collect()}
    want = {}
    for _, f in rows:
        seen, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for _, y in rows:
                if y not in seen and ((x ^ y) & (2**64 - 1)).bit_count() <= 2:
                    seen.add(y)
                    todo.append(y)
        want[f] = min((d for d, y in rows if y in seen and d is not None), default=None)
    assert got == want and want[rows[0][1]] == want[rows[2][1]] == 1 and want[rows[3][1]] is None


def test_contamination_is_judged_by_each_text(spark):
    item = " ".join(f"item{k}" for k in range(30))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(None, f"before {item} after"), (3, "a clean text of some words"), (3, f"also {item}"), (None, None), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, decontamination.drop_contaminated(docs, items).collect()), key=str) == sorted([(3, "a clean text of some words"), (None, None), (4, "")], key=str)


def test_digest_map_rules_out_no_key(spark):
    digest = F.unhex(F.substring(F.sha2(F.col("id").cast("string").cast("binary"), 256), 1, 32))
    keys = spark.range(0, 3000, 3).select(digest.alias("d"))
    found = common.maybe_among(spark.range(3000).withColumn("d", digest), F.col("d"), common.digest_map(keys, "d")).collect()
    assert len(found) == 3000 and all(r["__maybe"] for r in found if r["id"] % 3 == 0) and sum(r["__maybe"] for r in found) < 1020
    none = common.maybe_among(spark.range(9).withColumn("d", digest), F.col("d"), common.digest_map(keys.limit(0), "d")).collect()
    assert len(none) == 9 and not any(r["__maybe"] for r in none)
