"""Main text of pages: boosted trees over DOM nodes, decoded along the hierarchy.

Every element is a node with features of its own tag and attribute tokens, its depth, the
density of text and links in its subtree, and its siblings. Gradient-boosted trees give each
node the odds of being main text. Decoding then picks the most likely labelling in which a
dropped node drops all below it: a kept node lies under kept nodes only.

Labels come from the pages themselves, from a bounded sample of distinct pages: what lies in an
`article` or `main` element is text; navigation, footers, asides, forms and blocks named as
adverts, notices or comments are not. Only where no page has such an element, all that isn't
furniture is text. As templates differ from site to site, each sampled page is also seen in
rewritten layouts: with other wrappers around its article and its furniture, named by common
conventions, so that no single tag carries the decision.

Defined cases: null or empty html gives the empty text; a page without kept text too. Unclosed
and stray tags are taken as browsers take them. White space in a block is one space, blocks are
joined by one newline. Text outside of all elements is judged as that of a body. Where the trees
keep no text of a page, such as a mere fragment, what isn't furniture by its names is kept. A page of any
length takes time in proportion to it. Pages that repeat get equal texts; other columns stay, those
named like the results are replaced. With no page to learn from, or nothing but text in the
sample, all text is kept.
"""

from __future__ import annotations

import math
import random
import re

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dom import Node, parse
from .language_id import pa_schema
from .store import new_folder, table, written

# Tags and attribute words by what they commonly hold.
TEXT_TAGS = ("article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "section", "div", "li", "ul", "ol", "table", "td", "figure", "a", "span")
FURNITURE_TAGS = frozenset("nav footer aside form button select dialog menu label input fieldset".split())
TEXT_WORDS = frozenset("article articlebody body content entry main maincontent post story text prose copy".split())
FURNITURE_WORDS = {
    "menu": frozenset("breadcrumb breadcrumbs links menu menubar nav navbar navigation pager pagination toc tabs topnav navlist".split()),
    "edge": frozenset("banner bottom copyright foot footer head header masthead topbar bar".split()),
    "side": frozenset("aside complementary rail recommended related secondary sidebar side widget popular trending tags".split()),
    "notice": frozenset("alert consent cookie cookies dialog gdpr modal notice notification overlay popup privacy warning hidden paywall subscribe newsletter signup".split()),
    "advert": frozenset("ad ads advert advertisement adsense adslot promo promoted promotion sponsor sponsored banner".split()),
    "reader": frozenset("comment comments disqus discussion replies reply respond responses reactions".split()),
    "other": frozenset("author byline download login meta print search share sharing social tools form rating".split()),
}
#: Trees that keep everything.
KEEP_ALL = [(1.0, 1.0)]
FEATURES = [*(f"tag_{t}" for t in TEXT_TAGS), "tag_furniture", "words_text", *(f"words_{k}" for k in FURNITURE_WORDS), "above_text", "above_furniture", "above_words", "depth", "text", "density", "links", "siblings", "like_siblings", "place", "share", "paragraphs", "stops"]


def measured(page: str) -> tuple[list[Node], list[tuple[Node, str, bool]]]:
    """parse(), with the sizes of every subtree."""
    nodes, pieces = parse(page)
    for node, text, _ in pieces:
        node.text += len(text) - text.count(" ") if len(text) > 1 else 0
    for node in reversed(nodes):
        node.all_text += node.text
        node.all_tags += 1
        if node.tag == "a":
            node.inner_links = node.all_text
        if node.parent:
            node.parent.all_text += node.all_text
            node.parent.all_tags += node.all_tags
            node.parent.inner_links += node.inner_links
    return nodes, pieces


def features(nodes: list[Node]) -> list[list[float]]:
    """A row for each node, in page order: FEATURES."""
    total = max(1, nodes[0].all_text)
    above: dict[int, tuple[bool, bool, bool]] = {}
    place: dict[int, tuple[int, int, int]] = {}
    out = []
    for node in nodes:
        up = above.get(id(node.parent), (False, False, False))
        words = [bool(node.tokens & w) for w in FURNITURE_WORDS.values()] if node.tokens else [False] * len(FURNITURE_WORDS)
        furniture = node.tag in FURNITURE_TAGS
        above[id(node)] = (up[0] or node.tag in ("article", "main") or bool(node.tokens & TEXT_WORDS), up[1] or furniture, up[2] or any(words))
        tags = {}
        for child in node.children:
            tags[child.tag] = tags.get(child.tag, 0) + 1
        for i, child in enumerate(node.children):
            place[id(child)] = (i, len(node.children), tags[child.tag])
        i, siblings, like = place.get(id(node), (0, 1, 1))
        out.append(
            [
                *(float(node.tag == t) for t in TEXT_TAGS),
                float(furniture), float(bool(node.tokens & TEXT_WORDS)), *map(float, words), *map(float, up), float(min(node.depth, 30)),
                math.log1p(node.all_text), node.all_text / node.all_tags, node.inner_links / max(1, node.all_text), float(min(siblings, 50)), float(min(like, 50)), i / siblings,
                node.all_text / total, float(min(tags.get("p", 0), 50)), float(node.text > 0),
            ]
        )
    return out


def odds(trees: list[tuple[float, list]], x: list[float]) -> float:
    """Sum of the trees' weighted leaves: trees are nested (feature, threshold, left, right) or leaf values."""
    total = 0.0
    for weight, node in trees:
        while isinstance(node, tuple):
            node = node[2] if x[node[0]] <= node[1] else node[3]
        total += weight * node
    return 2 * total


def decode(nodes: list[Node], score: list[float]) -> set[int]:
    """ids of the nodes that are kept by the best labelling without contradictions.

    A node's say is its log-odds times the text that hangs directly on it (at least a little);
    keeping a node scores its say and the better of keep or drop for each child, dropping it
    scores minus the say of its whole subtree.
    """
    say = {id(n): s * (0.5 + math.log1p(n.text)) for n, s in zip(nodes, score, strict=True)}
    keep, drop = {}, {}
    for node in reversed(nodes):
        keep[id(node)] = say[id(node)] + sum(max(keep[id(c)], drop[id(c)]) for c in node.children)
        drop[id(node)] = -say[id(node)] + sum(drop[id(c)] for c in node.children)
    kept = {id(nodes[0])}
    for node in nodes[1:]:
        if id(node.parent) in kept and keep[id(node)] > drop[id(node)]:
            kept.add(id(node))
    return kept


def text_of(pieces: list[tuple[Node, str, bool]], kept: set[int], root: Node) -> str:
    blocks: list[list[str]] = []
    edge = True
    for node, text, before in pieces:
        edge = edge or before
        if id(node) not in kept or node is root:
            continue
        if edge or not blocks:
            blocks.append([])
        blocks[-1].append(text)
        edge = False
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def main_text(page: str | None, trees: list[tuple[float, list]]) -> str:
    if not page:
        return ""
    nodes, pieces = measured(page)
    score = [max(-6.0, min(6.0, odds(trees, x))) for x in features(nodes)]
    return text_of(pieces, decode(nodes, score), nodes[0]) or text_of(pieces, outside_furniture(nodes), nodes[0])


def outside_furniture(nodes: list[Node]) -> set[int]:
    """What neither is nor lies in furniture, by tags and attribute words."""
    out: set[int] = set()
    for node in nodes:
        if not _in_furniture(node) and (node.parent is None or id(node.parent) in out):
            out.add(id(node))
    return out


# Layouts for the rewritten training pages: wrappers of text and of furniture, as sites commonly name them.
TEXT_WRAPPERS = ['<article>|</article>', '<main>|</main>', '<div class="content">|</div>', '<div id="main-content"><div class="post-body">|</div></div>', '<main id="main"><article class="post">|</article></main>', '<section class="story">|</section>', '<div class="container"><div class="entry-content">|</div></div>', '<div itemprop="articleBody">|</div>', '<div class="wrapper"><div class="row"><div class="article-text">|</div></div></div>', '<div>|</div>']
FURNITURE = [
    '<nav><ul>{links}</ul></nav>', '<div class="menu"><ul>{links}</ul></div>', '<ul id="navigation">{links}</ul>', '<div class="breadcrumbs">{links}</div>', '<div class="pagination"><a>1</a> <a>2</a></div>',
    '<header><div class="masthead">{short}</div></header>', '<div id="header"><p>{short}</p></div>', '<footer>{short}</footer>', '<footer><p>{short}</p><ul>{links}</ul></footer>', '<div class="site-footer"><p>{short}</p></div>', '<div id="footer">{short}</div>',
    '<aside><h3>{title}</h3><p>{long}</p></aside>', '<div class="sidebar"><h3>{title}</h3><p>{short}</p></div>', '<aside class="related"><ul>{links}</ul></aside>', '<div id="sidebar"><div class="widget"><p>{long}</p></div></div>',
    '<div class="cookie-notice"><p>{short}</p><button>{title}</button></div>', '<div class="notice">{short}</div>', '<div role="alert">{short}</div>', '<div class="newsletter"><form><label>{title}</label><input></form></div>', '<div id="cookie-consent" class="popup">{short}</div>',
    '<div class="ad">{short}</div>', '<div class="advertisement"><p>{short}</p></div>', '<div class="sponsored"><p>{long}</p></div>', '<div id="ad-slot">{short}</div>', '<section class="promo"><p>{short}</p></section>',
    '<section class="comments"><h3>{title}</h3><div class="comment"><p>{long}</p></div><div class="comment"><p>{short}</p></div></section>', '<div id="comments"><ul><li class="comment"><p>{long}</p></li><li class="comment"><p>{short}</p></li></ul></div>', '<div class="discussion"><article class="comment"><p>{short}</p></article></div>',
    '<form><p>{short}</p><label>{title}</label><select><option>{title}</option></select><button>{title}</button></form>', '<div class="share">{links}</div>', '<div class="search"><form><input><button>{title}</button></form></div>',
]


def _in_furniture(node: Node) -> bool:
    return node.tag in FURNITURE_TAGS or any(node.tokens & w for w in FURNITURE_WORDS.values())


def labelled_rows(page: str, rng: random.Random, rewrites: int) -> list[tuple[float, list[float]]]:
    """(label, features) of the nodes of a page and of its rewritten layouts. If the page names no article, what isn't furniture is one."""
    nodes, pieces = measured(page)
    good: dict[int, float] = {}
    for node in nodes:
        inside = good.get(id(node.parent), 0.0)
        good[id(node)] = 0.0 if _in_furniture(node) else 1.0 if node.tag in ("article", "main") else inside
    if not any(good.values()):
        good |= dict.fromkeys(outside_furniture(nodes), 1.0)
    around = {id(n) for n in nodes if good[id(n)]}
    for node in reversed(nodes):  # what holds an article must be kept for it
        if node.parent and good[id(node)] and not _in_furniture(node.parent):
            good[id(node.parent)] = 1.0
    rows = [(good[id(n)], x) for n, x in zip(nodes, features(nodes), strict=True)][1:]
    texts = [t for t in text_of([p for p in pieces if id(p[0]) in around], around, nodes[0]).split("\n") if t]
    words = re.findall(r"[^\s<>&]+", " ".join(texts)) or ["x"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for _ in range(rewrites if texts else 0):
        fill = lambda s: s.format(links="".join(f"<li><a>{some(rng.randint(1, 3))}</a></li>" for _ in range(rng.randint(2, 8))), title=some(2), short=some(rng.randint(3, 12)), long=some(rng.randint(12, 60)))
        opening, closing = rng.choice(TEXT_WRAPPERS).split("|")
        body = [f"<h1>{some(6)}</h1>" if rng.random() < 0.7 else ""]
        for t in texts:
            t = " ".join(re.findall(r"[^\s<>&]+", t))
            kind = rng.random()
            body.append(f"<ul><li>{t}</li></ul>" if kind < 0.06 else f"<blockquote><p>{t}</p></blockquote>" if kind < 0.12 else f"<h2>{some(3)}</h2><p>{t}</p>" if kind < 0.24 else f"<div>{t}</div>" if kind < 0.3 else f"<p>{t} <a>{some(2)}</a> <b>{some(1)}</b></p>" if kind < 0.45 else f"<p>{t}</p>")
        if rng.random() < 0.4:  # furniture inside the text
            body.insert(rng.randint(0, len(body)), fill(rng.choice(FURNITURE)).replace("<", "<!--f--><", 1))
        before, after = ([fill(f) for f in rng.sample(FURNITURE, rng.randint(1, 5))] for _ in range(2))
        new, _ = measured(f"<html><body>{''.join(before)}{opening}<i data-start></i>{''.join(body)}{closing}{''.join(after)}</body></html>")
        start = next(n for n in new if n.tag == "i" and not n.text and not n.children)
        label: dict[int, float] = {}
        chain, up = set(), start.parent
        while up:
            chain.add(id(up))
            up = up.parent
        for n in new:
            inside = n is start.parent or label.get(id(n.parent), 0.0) == 1.0 and id(n) not in chain and (id(n.parent) not in chain or n.parent is start.parent)
            label[id(n)] = 1.0 if id(n) in chain or (inside and not _in_furniture(n)) else 0.0
        rows += [(label[id(n)], x) for n, x in zip(new, features(new), strict=True) if n.parent and n is not start]
    return rows


def sampled_rows(pages: DataFrame, n_pages: int, rewrites: int, chars_per_page: int) -> DataFrame:
    """label, features of a sample of n_pages distinct pages, first by hash of those that name an article if any does;
    each page's layouts are drawn from its own seed."""
    order = F.xxhash64(F.lit("sample"), "html")
    keyed = pages.filter("html IS NOT NULL").select(F.substring("html", 1, chars_per_page).alias("html"), order.alias("o"), F.col("html").rlike(r"(?i)<(article|main)[\s>]").alias("named"))
    first = keyed.select("named", "o").distinct().orderBy(F.desc("named"), "o").limit(n_pages)
    first = first.join(first.agg(F.max("named").alias("some")), F.col("named") == F.col("some")).select("o")
    sample = keyed.join(F.broadcast(first), "o", "left_semi").dropDuplicates(["o"]).repartition(8, "o")

    def run(batches):
        for batch in batches:
            rows = [r for page, o in zip(batch.column("html").to_pylist(), batch.column("o").to_pylist(), strict=True) for r in labelled_rows(page, random.Random(o), rewrites)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["label", "x"])

    return sample.select("html", "o").mapInArrow(run, "label double, x array<double>")


def train(pages: DataFrame, n_pages: int = 240, rewrites: int = 4, trees: int = 20, depth: int = 5, chars_per_page: int = 1_000_000) -> list[tuple[float, list]]:
    """The boosted trees, learned from a sample of at most n_pages pages and chars_per_page characters of each, as nested tuples."""
    spark = pages.sparkSession
    rows = written(sampled_rows(pages, n_pages, rewrites, chars_per_page), "dom-nodes")
    if rows.select("label").distinct().count() < 2:
        return KEEP_ALL
    df = rows.select("label", array_to_vector("x").alias("features")).coalesce(4)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, checkpointInterval=-1).fit(df)
    path = new_folder(spark, "boosted-trees")
    model.write().save(path)
    return nested(spark, path, list(model.treeWeights))


def nested(spark: SparkSession, path: str, weights: list[float]) -> list[tuple[float, list]]:
    """A saved model's trees; trees x 2^depth rows."""
    by_tree: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        by_tree.setdefault(r.treeID, {})[r.id] = r

    def build(own, i):
        r = own[i]
        return float(r.prediction) if r.leftChild < 0 else (r.split.featureIndex, r.split.leftCategoriesOrThreshold[0], build(own, r.leftChild), build(own, r.rightChild))

    return [(weights[k], build(own, 0)) for k, own in sorted(by_tree.items())]


def extract(pages: DataFrame, trees: list[tuple[float, list]], html: str = "html") -> DataFrame:
    """pages with text, their main text, and n_chars."""
    pages = pages.drop("text", "n_chars")

    def run(batches):
        for batch in batches:
            texts = [main_text(p, trees) for p in batch.column(batch.schema.get_field_index(html)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*batch.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, pa_schema(pages, {"text": "string", "n_chars": "long"}))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).drop("html")
