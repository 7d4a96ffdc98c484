"""Main text of web pages by the style tree of their site.

The trees of one host's pages are merged: a node of the style tree is a path of tags and classes below the host, repeated
siblings being one. A node's presentation is how its pages differ in the children it has, its content how they differ in the text
that stands in it, both as entropy with the number of pages as base: a text on one page only is worth 1, one that stands on all is worth 0. A
branch is worth the most of its nodes. Branches that most pages of a host have and that are worth little are removed from each page, as
are those whose tag, role or class says what they are. An article is what its element says, or else the branch with the most text.

Rows of the tree are keyed by host and path together and counted by Spark, so a host with a third of all pages is no hot key.
Pages whose main text is the same count once, so copies don't make a text look like a template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import over_batches, spread_join, stored, table

# Elements and marks of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul head noscript template iframe object svg button select canvas audio video".split())
RAW = frozenset("script style textarea title xmp noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - frozenset("html head body caption tbody td tfoot th thead tr option optgroup noscript template iframe object svg button select canvas audio video".split())
#: Of an element, which open ones its start ends, and at which it stops looking.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})} | {h: (HEADINGS, {"article", "section", "div", "td"}) for h in HEADINGS}
NOISE_TAGS = frozenset("head nav footer aside form dialog menu noscript template iframe object svg button select canvas audio video search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog".split())
NOISE_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices gdpr popup modal newsletter subscribe subscription share sharing social related recommended comment comments disqus respond pagination pager toolbar topbar masthead login search widget".split()
)
#: Words of a class by which it speaks of what stands beside the element.
BESIDE = frozenset("with has no without".split())
ARTICLE_CLASSES = frozenset("article-body article-content article-text articlebody entry-content post-content post-body story-body main-content content-main".split())

#: A branch below this worth is removed, if so many pages of its host have it, and so large a part of them.
WORTH, LEAST_PAGES, LEAST_SHARE = 0.3, 5, 0.5
MOST_DEPTH = 48  # deeper nodes count as their ancestor at that depth
MOST_LINKED = 0.5  # part of a branch's characters that may be links, where no element names the article
NOISY_BROADCAST = 200_000  # nodes

NEXT = re.compile(r"<(?:!--|[/!?a-zA-Z])")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, what): text ('', '', text), starts ('+', tag, attributes) and ends ('-', tag, ''). Comments, declarations and the content of
    scripts, styles, titles and text areas are passed over; a tag that is cut off at the end of the page is too.
    Once a quote is left open, tags are read up to their next bracket, so a page is read in linear time."""
    at, n, tag = 0, len(html), TAG
    while at < n:
        m = NEXT.search(html, at)
        if m is None:
            yield "", "", html[at:]
            return
        if m.start() > at:
            yield "", "", html[at : m.start()]
        at = m.start()
        if m[0] == "<!--":
            end = html.find("-->", at + 2)
            at = n if end < 0 else end + 3
            continue
        if m[0] in ("<!", "<?"):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        t = tag.match(html, at)
        if t is None and tag is TAG and (m[0] != "</"):
            t = PLAIN_TAG.match(html, at)
            tag = PLAIN_TAG
        elif t is None:
            t = PLAIN_TAG.match(html, at)
        if t is None:
            if m[0] == "</":
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            else:
                at = n
            continue
        name = t[2].lower()
        at = t.end()
        if t[1]:
            yield "-", name, ""
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
            continue
        yield "+", name, t[3]


@dataclass(slots=True)
class Node:
    tag: str
    path: tuple[int, ...]  # the nodes of the style tree from the host's down to this one
    noise: bool
    inside: int  # 1 inside a main element, 2 inside an article, else 0
    heading: bool
    inline: bool = False  # of noise inside a block, which goes on behind it


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    linked: int  # characters of it inside links


def _marks(attributes: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}


def _child(parent: Node, tag: str, attributes: str) -> Node:
    marks = _marks(attributes)
    classes = f"{marks.get('class', '')} {marks.get('id', '')}".split()
    words = set(re.split(r"[^a-z]+", " ".join(classes)))
    inside = parent.inside
    if tag == "article" or marks.get("itemprop") == "articlebody" or ARTICLE_CLASSES & {*classes}:
        inside = 2
    elif tag == "main" or marks.get("role") == "main":
        inside = max(inside, 1)
    noise = parent.noise and not (parent.tag == "form" and inside > parent.inside)
    if tag not in ("html", "body", "main") and not (tag == "article" and not {*classes} & {"comment", "comments", "related", "ad", "ads", "sponsored"}):
        noise |= tag in NOISE_TAGS or (tag == "header" and not inside) or marks.get("role") in NOISE_ROLES
        noise |= bool(words & NOISE_CLASSES) and not words & BESIDE
        noise |= "header" in words and not inside and tag not in HEADINGS
    path = parent.path
    if len(path) < MOST_DEPTH:
        look = " ".join(sorted(c for c in classes if not re.search(r"\d", c)))
        path = (*path, xxhash.xxh64_intdigest(f"{path[-1]} {tag} {look}") - (1 << 63))
    return Node(tag, path, noise, inside, parent.heading or tag in HEADINGS)


def parse(html: str, root: int) -> tuple[list[Block], dict[Node, list[int]]]:
    """The blocks of text of a page in order, and the children of each element that has any."""
    top = Node("", (root,), False, 0, False)
    stack, opened = [top], Counter()
    blocks: list[Block] = []
    children: dict[int, tuple[Node, list[int]]] = {}
    pieces: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split()) if pieces else ""
        if text:
            blocks.append(Block(stack[-2] if stack[-1].inline else stack[-1], text, min(linked, len(text))))
        pieces.clear()
        linked = 0

    def close(upto: int) -> None:
        if not (upto == len(stack) - 1 and stack[-1].inline):
            flush()
        while len(stack) > upto:
            opened[stack.pop().tag] -= 1

    def last(names: set[str] | frozenset[str], stop: set[str]) -> int | None:
        """The place of the topmost open element of these names, if none of stop is above it."""
        if not any(opened[x] > 0 for x in names):
            return None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                return k
            if stack[k].tag in stop:
                return None
        return None

    for kind, name, what in tokens(html):
        if not kind:
            if stack[-1].inline:
                continue
            text = unescape(what) if "&" in what else what
            pieces.append(text)
            linked += len(text) if links else 0
        elif kind == "+":
            if name == "br":
                pieces.append(" ")
                continue
            if name == "a":
                links = 1
            if name in VOID:
                if name == "hr":
                    flush()
                continue
            if name not in BLOCKS:
                if "=" in what and (child := _child(stack[-1], name, what)).noise and not stack[-1].noise:
                    child.inline = True
                    stack.append(child)
                    opened[name] += 1
                continue
            if name in CLOSES_P and opened["p"] > 0 and (k := last({"p"}, {"td", "th", "button", "object"})) is not None:
                close(k)
            if name in ENDS:
                ends, stop = ENDS[name]
                while (k := last(ends, stop)) is not None:
                    close(k)
            flush()
            child = _child(stack[-1], name, what)
            children.setdefault(id(stack[-1]), (stack[-1], []))[1].append(child.path[-1])
            stack.append(child)
            opened[name] += 1
        else:
            if name == "a":
                links = 0
            if opened[name] > 0 and (k := last({name}, {"td", "th"} if name == "p" else set())) is not None:
                close(k)
            elif name in BLOCKS:
                flush()
    flush()
    return blocks, list(children.values())


def article(blocks: list[Block], noisy: frozenset[int] | set[int] = frozenset()) -> list[Block]:
    """The blocks of the article. noisy has the nodes whose branches the site's style tree removes. Headings and the branch with the
    most text are never removed by it."""
    kept = [b for b in blocks if not b.node.noise]
    level = max((b.node.inside for b in kept), default=0)
    if level == 2:
        first = next(k for k, b in enumerate(kept) if b.node.inside == 2)
        kept = [b for k, b in enumerate(kept) if b.node.inside == 2 or (k < first and b.node.inside == 1 and b.node.tag == "h1")]
    elif level == 1:
        kept = [b for b in kept if b.node.inside]
    size: Counter[int] = Counter()
    linked: Counter[int] = Counter()
    for b in kept:
        size[b.node.path[-1]] += len(b.text)
        linked[b.node.path[-1]] += b.linked
    main = max(size, key=size.__getitem__, default=None)

    def stays(b: Block) -> bool:
        own = b.node.path[-1]
        if own == main or (level and b.node.heading):
            return True
        if not level and linked[own] > MOST_LINKED * size[own]:
            return False
        return not noisy or noisy.isdisjoint(b.node.path)

    return [b for b in kept if stays(b)]


def page_text(html: str, root: int = 0, noisy: frozenset[int] | set[int] = frozenset()) -> str:
    return "\n".join(b.text for b in article(parse(html, root)[0], noisy))


PRESENCE, CONTENT, STYLE = 0, 1, 2
TREE = "node long, kind int, feature long, page long, path array<long>"


def tree_rows(html: str, root: int) -> list[tuple[int, int, int, int, list[int] | None]]:
    """TREE rows of a page: the nodes it has with their paths, the texts in them and the children they have. A page is named by the
    digest of its article. What its marks take out already has no rows, but counts among the children."""
    blocks, children = parse(html, root)
    signed = lambda s: xxhash.xxh64_intdigest(s) - (1 << 63)
    page = signed("\n".join(b.text for b in article(blocks)))
    nodes: dict[int, list[int]] = {root: [root]}
    out = set()
    for b in blocks:
        if not b.node.noise:
            nodes[b.node.path[-1]] = list(b.node.path)
            out.add((b.node.path[-1], CONTENT, signed(b.text)))
    for node, below in children:
        if not node.noise and len(node.path) < MOST_DEPTH:
            nodes[node.path[-1]] = list(node.path)
            once = [c for k, c in enumerate(below) if not k or c != below[k - 1]]
            out.add((node.path[-1], STYLE, signed(" ".join(map(str, once)))))
    rows = [(n, PRESENCE, 0, page, path) for n, path in nodes.items()]
    return rows + [(n, kind, feature, page, None) for n, kind, feature in out]


def with_roots(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, root): root names the host; 0 where the url has none."""
    host = F.lower(F.regexp_extract(pages["url"].cast("string"), HOST, 1))
    root = F.when(F.coalesce(host, F.lit("")) != "", F.xxhash64(host)).otherwise(0)
    return pages.select("page_id", pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"), root.alias("root"))


def style_tree(pages: DataFrame) -> DataFrame:
    """(root, node, n_pages, worth) of the nodes of all hosts, from (html, root)."""

    def rows(batch: pa.RecordBatch) -> dict:
        found = [r for html, root in zip(*(batch.column(k).to_pylist() for k in (0, 1))) for r in tree_rows(html, root)]
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        return {f.split()[0]: pa.array(list(c), t) for f, c, t in zip(TREE.split(", "), zip(*found), types)} if found else {f.split()[0]: pa.array([], t) for f, t in zip(TREE.split(", "), types)}

    found = over_batches(pages.where("root <> 0").select("html", "root"), rows, TREE)
    counted = found.groupBy("node", "kind", "feature").agg(F.count_distinct("page").alias("c"), F.first("path", True).alias("path"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    c, log = F.col("c"), F.log(F.col("c").cast("double"))
    sums = counted.groupBy("node").agg(
        of(PRESENCE, c).alias("m"), F.first("path", True).alias("path"), of(CONTENT, F.lit(1)).alias("texts"), of(CONTENT, log).alias("text_logs"), of(STYLE, c).alias("styles"), of(STYLE, c * log).alias("style_logs")
    )
    base = F.log(F.col("m").cast("double"))
    content = F.coalesce(1 - F.col("text_logs") / (F.col("texts") * base), F.lit(0.0))
    style = F.coalesce((F.log(F.col("styles").cast("double")) - F.col("style_logs") / F.col("styles")) / base, F.lit(0.0))
    worth = F.when(F.col("m") > 1, F.greatest(content, style)).otherwise(1.0)
    nodes = sums.select("node", "m", "path", worth.alias("worth"))
    above = nodes.select(F.explode("path").alias("node"), "worth", "m", F.get("path", F.lit(0)).alias("root"), (F.col("node") == F.element_at("path", -1)).alias("__own"), F.col("node").alias("__of"))
    own = F.when(F.col("__of") == F.col("node"), F.col("m"))
    return above.groupBy("node").agg(F.first("root").alias("root"), F.max(own).alias("n_pages"), F.max("worth").alias("worth"))


def noisy_branches(tree: DataFrame) -> DataFrame:
    """(root, noisy): of each host the nodes that are worth less than WORTH though most of its pages have them; the host itself has to be worth
    more, else its pages are all alike and nothing can be told. As such a node is on LEAST_SHARE of the pages, a host has at most
    1 / LEAST_SHARE times as many as a page has on average."""
    roots = tree.where("node = root").where(F.col("worth") >= WORTH).select("root", F.col("n_pages").alias("__pages"))
    low = tree.where((F.col("worth") < WORTH) & (F.col("n_pages") >= LEAST_PAGES))
    met = spread_join(low, roots, ["root"], F.col("node"))
    return met.where(F.col("n_pages") >= LEAST_SHARE * F.col("__pages")).groupBy("root").agg(F.collect_set("node").alias("noisy"))


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages (page_id, url, html).

    A null html counts as empty and gives an empty text, as does a page that has nothing but what is removed. Pages without a host are judged
    by their own marks alone. Repeated rows stay repeated; an empty table gives an empty result; other columns are ignored."""
    rooted = with_roots(pages)
    noisy = stored(noisy_branches(stored(style_tree(rooted), "style-tree")), "noisy")
    size = noisy.agg(F.sum(F.size("noisy"))).first()[0] or 0
    met = rooted.join(F.broadcast(noisy), "root", "left") if size <= NOISY_BROADCAST else spread_join(rooted, noisy, ["root"], F.xxhash64("page_id", "html"), "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def extract(batch: pa.RecordBatch) -> dict:
        html, root, below = (batch.column(k).to_pylist() for k in (2, 3, 4))
        texts = [page_text(h, r, frozenset(b or ())) for h, r, b in zip(html, root, below)]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return over_batches(met.select("page_id", "url", "html", "root", "noisy"), extract, f"page_id {kind}, url string, text string, n_chars long")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return main_texts(table(spark, sf_dir, "pages"))
