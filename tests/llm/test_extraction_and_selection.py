"""HTML extraction, importance resampling and spelling variants against plain calculations, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("ledgerlake.llm.registry")

from ledgerlake.llm import common, html_extraction, importance_resampling, registry, spelling_variants  # noqa: E402

AZ = {i: i + 32 for i in range(65, 91)}
LONG = "word " * 30_000
EDGE = [(1, "Small words of a small text", 1), (2, "Small words of a small text", 1), (3, "", 2), (4, None, 3), (5, LONG, 4), (5, LONG, 4), (None, "a text without an id é 日本 ÀÉ", 5), (6, " \n\t ", 6)]


def edge(spark, empty=False):
    return spark.createDataFrame([] if empty else [(*r, 7, "x", 8) for r in EDGE], "doc_id long, text string, row int, n long, word string, score int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="with-sidebar">
<header><h1>My site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div><aside>Side</aside>
<form><p>Your name <input name=x></p></form><!-- <p>no</p> --><main><h1>The&nbsp;title</h1><article class="post comments-open"><p>One &lt;b&gt; <b>two
  three<br>four<p>five &amp <i>six</i> &#233;<ul><li>seven<li>eight</ul><div class="ad-box"><p>Buy</p></div><table><tr><td>nine<td>ten</table>
<header>by A. B.</header><p>eleven<span class="share"> tell a friend</span> twelve</p><footer>Filed</footer><section id="comments"><article>I agree</article></section></article></main><footer>&copy; host</footer></body>"""


def test_page_text():
    got = html_extraction.page_text(PAGE).split("\n")
    assert got == ["The title", "One <b> two three four", "five & six é", "seven", "eight", "nine", "ten", "by A. B.", "eleven twelve"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>a<p>b", "a\nb"),
        ("<article>a<p b='>'>c</p>d<p title=\"x>e</article>", "a\nc\nd\ne"),
        ("<article><p>a</b></i></p></div>b</article>", "a\nb"),
        ("<article>1 < 2 && 3 &gt; 2 &nosuch; &am</article>", "1 < 2 && 3 > 2 &nosuch; &am"),
        ("<article>a<script>x</SCRIPT >b<style>never closed", "ab"),
        ("<ARTICLE><P>A</P></ARTICLE>after", "A"),
        ("<form><main><p>a</main>b</form>", "a"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<article>a<!-- b", "a"),
        ("<article>a<p", "a"),
    ],
)
def test_small_pages(html, text):
    assert html_extraction.page_text(html) == text


def test_long_pages_take_linear_time():
    for part in ("<a '", "<p>", "</b>", "<b class=ad>", '<x "', "<li>", "&amp", "<!-"):
        html_extraction.page_text(part * 40_000)


def site(n=12):
    """Pages without an element that names the article: a line that all have, a box with three texts in turn, links, and a text of their own."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(400)]
    out = []
    for k in range(n):
        own = [" ".join(rng.choices(words, k=30)) for _ in range(3)]
        html = f"<html><body><div class=x1>Welcome to this place</div><div class=x2><p>Box {k % 2}</p></div><ul>{'<li><a href=/>Link ' * 3}</ul><div class=t><h2>Part</h2>{''.join(f'<p>{p}</p>' for p in own)}</div></body></html>"
        out.append((k, f"http://h.example.org/{k}", html, "\n".join(["Part", *own])))
    return out


def test_site_without_articles(spark):
    pages = site()
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.main_texts(df).collect()}
    # the heading that all pages have is a branch of its own here, as nothing says that it is the article's
    assert got == {k: text.removeprefix("Part\n") for k, _, _, text in pages}


def test_copies_of_a_page_are_no_template(spark):
    """Pages all alike but for their menu keep their text: nothing on them is worth more than the rest."""
    html = "<div class=a>All of this text is on each of the pages</div><div class=b>{}</div>"
    df = spark.createDataFrame([(k, "http://h/x", html.format(k % 2)) for k in range(20)], "page_id long, url string, html string")
    assert all(r.text.startswith("All of this text") for r in html_extraction.main_texts(df).collect())


def test_style_tree_against_a_plain_one(spark):
    pages = site(9)
    pages += pages[:2]  # copies count once
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.node: (r.n_pages, round(r.worth, 9)) for r in html_extraction.style_tree(html_extraction.with_roots(df)).collect()}
    root = html_extraction.with_roots(df).first()["root"]
    on, texts, styles, paths = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set)), {}
    for _, _, html, _ in pages:
        for node, kind, feature, page, path in html_extraction.tree_rows(html, root):
            if kind == html_extraction.PRESENCE:
                on[node].add(page)
                paths[node] = path
            else:
                (texts if kind == html_extraction.CONTENT else styles)[node][feature].add(page)
    worth = {}
    for node, seen in on.items():
        m = len(seen)
        if m == 1:
            worth[node] = 1.0
            continue
        log = lambda x: math.log(x) / math.log(m)  # noqa: B023, E731
        content = 1 - sum(log(len(p)) for p in texts[node].values()) / len(texts[node]) if texts[node] else 0.0
        total = sum(map(len, styles[node].values()))
        shares = [len(p) / total for p in styles[node].values()]
        worth[node] = max(content, -sum(p * log(p) for p in shares))
    best = {n: max(worth[k] for k in on if n in paths[k]) for n in on}
    assert got == {n: (len(on[n]), round(best[n], 9)) for n in on}


def test_extraction_edges(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "http://a/", "<p>x</p>", 1), (2, "no url", "", 1), (2, "no url", "", 1), (3, "http://a/", "<p>" + LONG, 1)], "page_id long, url string, html string, root int")
    assert rows(html_extraction.main_texts(df)) == sorted([(1, None, "", 0), (None, "http://a/", "x", 1), (2, "no url", "", 0), (2, "no url", "", 0), (3, "http://a/", LONG.strip(), len(LONG) - 1)], key=str)
    assert rows(html_extraction.main_texts(df.limit(0))) == []


def test_op11_gives_each_article(spark, sf):
    import html

    got = {r.page_id: (r.url, r.text, r.n_chars) for r in registry.QUERIES["op11_html_extraction"](spark, sf).collect()}
    pages = common.table(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search("<article>(.*)</article>", p.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:h1|p)>", inner.replace("<br>", " "))]
        text = "\n".join(b for b in blocks if b)
        assert got[p.page_id] == (p.url, text, len(text))


# -- importance resampling

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(x):
    w = WORDS.findall((x or "").translate(AZ))
    return len(w), [f"{zlib.crc32(f.encode()) % 10_000}" for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain_draw(docs, target):
    s, t = Counter(), Counter()
    parts = [(d, *features(x)) for d, x in docs]
    for _, _, f in parts:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for d, n, f in parts:
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f)) // len(f) if f else 0
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: 25 * len(able) // 100]
    ranks = {id(r): k + 1 for k, r in enumerate(drawn)}
    return [(*r[:4], ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("small", [False, True])
def test_op12_against_a_plain_draw(spark, sf, monkeypatch, small):
    if small:  # many ranges, runs and blocks
        for name, n in (("RANGE_ROWS", 7), ("RUN_ROWS", 20), ("BLOCK_ROWS", 3), ("MOST_BYTES", 5000)):
            monkeypatch.setattr(importance_resampling, name, n)
    docs = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    target = [r.text for r in common.table(spark, sf, "benchmark").collect()]
    assert rows(registry.QUERIES["op12_importance_resampling"](spark, sf)) == sorted(plain_draw(docs, target), key=str)


def test_feature_buckets_of_slices():
    rng = random.Random(1)
    for _ in range(150):
        texts = ["".join(rng.choice("aBZz09 é日😀.-_`{\x7f\x80\n" + "q" * 9) for _ in range(rng.choice([0, 0, 3, 40, 400]))) for _ in range(rng.randint(0, 30))]
        at = rng.randint(0, len(texts))
        upto = rng.randint(at, len(texts))
        bucket, of, n = importance_resampling.feature_buckets(pa.array(texts, pa.string()).slice(at, upto - at))
        plain = [features(x) for x in texts[at:upto]]
        assert n.tolist() == [p[0] for p in plain]
        got = defaultdict(list)
        for b, k in zip(bucket.tolist(), of.tolist()):
            got[k].append(str(b))
        assert all(sorted(got[k]) == sorted(f) for k, (_, f) in enumerate(plain))


def test_tournament_tree():
    rng = random.Random(2)
    for k in range(60):
        runs = [sorted((rng.randint(0, 50), rng.random()) for _ in range(rng.randint(0, 30))) for _ in range(k % 9)]
        tree = importance_resampling.TournamentTree([iter(r) for r in runs])
        stop = rng.randint(0, 100)
        got = [x for _ in range(stop) if (x := tree.pop()) is not None]
        all_ = sorted(x for r in runs for x in r)
        assert got == all_[:stop] and sorted(tree.rest()) == all_[stop:]


def test_resampling_edges(spark):
    target = spark.createDataFrame([("small words",), (None,)], "text string")
    many = edge(spark)
    got = importance_resampling.resampled(many, target).select("doc_id", "n_features", "weight", "score", "rank")
    want = plain_draw([(d, t) for d, t, _ in EDGE], ["small words", None])
    assert Counter(map(str, rows(got.drop("rank")))) == Counter(str(r[:4]) for r in want)
    assert rows(importance_resampling.resampled(edge(spark, True), target)) == []
    assert len(rows(importance_resampling.resampled(many, target.limit(0)))) == len(EDGE)
    # repeated rows, rows without doc_id among them, are drawn each for itself
    copies = spark.createDataFrame([(None if k % 2 else 9, "one two three " * 10) for k in range(40)], "doc_id long, text string")
    ranks = sorted(r.rank for r in importance_resampling.resampled(copies, target).collect() if r.rank)
    assert ranks == list(range(1, 11))


# -- spelling variants


def plain_variants(counts, times=5):
    shapes, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            shapes[w[:i] + "?" + w[i + 1 :]].add(w)
            if (v := w[:i] + w[i + 1 :]) in counts:
                near[w].add(v)
                near[v].add(w)
    for group in shapes.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda v: (-counts[v], v), default=None) for w in counts}
    form = {w: b if b and counts[b] >= times * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()), key=str)


def plain_counts(docs):
    counts = Counter()
    for d, x in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            w = run.translate(AZ)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_op13_against_a_plain_search(spark, sf):
    docs = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    want = plain_variants(plain_counts(docs))
    assert rows(registry.QUERIES["op13_spelling_variants"](spark, sf).select("word", "form", "root", "n", "n_near", "form_n")) == want
    assert sum(r[4] for r in want) > 50


@pytest.mark.parametrize("signs", ["ab", "aÿ", "abcdefgh"])
def test_links_of_dense_words(spark, signs):
    """Words of few letters: many neighbours at every place, the ends and runs of one letter among them."""
    rng = random.Random(4)
    counts = {"".join(rng.choice(signs) for _ in range(rng.randint(1, 9))): rng.choice([1, 1, 5, 25, 125, 7]) for _ in range(400)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows(spelling_variants.variants(df).select("word", "form", "root", "n", "n_near", "form_n")) == plain_variants(counts)


def test_wavelet_tree():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 37, 100):
        ranks = rng.permutation(n)
        lo, hi, least, most = (rng.integers(0, n + 1, 50) for _ in range(4))
        q, rank = spelling_variants.WaveletTree(ranks).report(lo, hi, least, most)
        want = sorted((k, r) for k in range(50) for r in ranks[lo[k] : hi[k]].tolist() if least[k] <= r < most[k])
        assert sorted(zip(q.tolist(), rank.tolist())) == want


def test_variants_edges(spark):
    words = spelling_variants.word_counts(edge(spark), 199, 4, 1)
    assert {r.word: r.n for r in words.collect()}["words"] == 2
    assert rows(spelling_variants.variants(words.limit(0))) == []
    assert rows(spelling_variants.word_counts(edge(spark, True))) == []
    one = spark.createDataFrame([("abcdefg" * 40, 9), ("abcdefg" * 40 + "x", 45)], "word string, n long")
    assert [(r.n_near, r.form_n) for r in spelling_variants.variants(one).orderBy("n").collect()] == [(1, 45), (1, None)]
    chain = [("a" * 6 + "bcdefgh"[:k], 5**k) for k in range(8)]
    found = spelling_variants.variants(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r.root for r in found} == {"aaaaaabcdefgh"} and sum(r.form is None for r in found) == 1
