"""Main text of web pages: boosted trees over DOM-node features, decoded along the tree.

A page becomes a tree of block elements whose leaves are runs of text. The trees give every node a log-odds of holding
main text. A node can be main only if its parent is, so the best consistent choice is found from the leaves up: a subtree
is kept when its own value and those of its kept children add up to more than nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.storage import stored

#: Fixed parameters of a fit: pages it learns from (the bound of the sample), trees, their depth, seed.
SAMPLE, TREES, DEPTH, SEED = 300, 12, 4, 3

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template title svg math iframe object select textarea button datalist canvas audio video noscript".split())
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset table thead tbody tfoot tr td th "
    "caption blockquote pre figure figcaption address details summary hgroup dialog menu search".split()
)
#: A start tag ends the open elements of these names, up to a barrier.
ENDS = {
    **dict.fromkeys("article main section div p h1 h2 h3 h4 h5 h6 ul ol dl nav header footer aside form fieldset table blockquote pre figure figcaption address details hr".split(), frozenset({"p"})),
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
    "tbody": frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}), "tfoot": frozenset({"thead", "tbody", "tr", "td", "th", "p"}),
}
BARRIER = {"li": frozenset({"ul", "ol", "menu"}), "dt": frozenset({"dl"}), "dd": frozenset({"dl"})}
TABLE = frozenset({"table"})
SCOPE = frozenset({"html", "body", "div", "article", "main", "section", "td", "th", "table", "blockquote", "li", "aside", "nav", "header", "footer", "form"})
#: Words in class, id and role that often name main text, and what surrounds it.
GOOD = frozenset("article body content entry main post prose story text".split())
BAD = frozenset(
    "ad ads advert advertisement author banner bar breadcrumb breadcrumbs byline comment comments consent cookie copyright disqus footer form header links login "
    "masthead menu meta modal nav navbar navigation newsletter notice pagination pager popup privacy promo promotion related reply respond search share sharing "
    "sidebar signup social sponsor sponsored subscribe tags toolbar widget".split()
)
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attributes: tuple[str, ...] = ()
    children: list[int] = field(default_factory=list)
    text: str = ""
    linked: int = 0
    #: its number among its siblings
    place: int = 0


class Builder(HTMLParser):
    """The block tree of a page. Node 0 is the root; leaves have the tag ``#text``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("#root", -1, 0)]
        #: open elements: (tag, number of its block or None)
        self.open: list[tuple[str, int | None]] = []
        self.blocks = [0]
        self.unseen = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0

    def end_run(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            at = self.blocks[-1]
            self.nodes[at].children.append(len(self.nodes))
            self.nodes.append(Node("#text", at, self.nodes[at].depth + 1, (), [], text, min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def close_to(self, size: int) -> None:
        while len(self.open) > size:
            tag, block = self.open.pop()
            if block is not None:
                self.end_run()
                self.blocks.pop()
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                self.parts.append(" ")
                if tag == "hr":
                    self.end_run()
            return
        ended = ENDS.get(tag)
        if ended:
            barrier = BARRIER.get(tag, TABLE if tag in ("tr", "td", "th", "tbody", "tfoot") else SCOPE)
            cut = None
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in ended:
                    cut = i
                elif self.open[i][0] in barrier:
                    break
            if cut is not None:
                self.close_to(cut)
        if tag == "body" and any(t == "head" for t, _ in self.open):
            self.close_to(next(i for i, (t, _) in enumerate(self.open) if t == "head"))
        block = None
        if tag in BLOCK:
            self.end_run()
            block = len(self.nodes)
            at = self.blocks[-1]
            words = tuple(w for k, v in attrs if k in ("class", "id", "role") and v for w in re.split("[^a-z0-9]+", re.sub("([a-z])([A-Z])", r"\1 \2", v).lower()) if w)
            self.nodes[at].children.append(block)
            self.nodes.append(Node(tag, at, self.nodes[at].depth + 1, words))
            self.blocks.append(block)
        self.unseen += tag in UNSEEN
        self.links += tag == "a"
        self.open.append((tag, block))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # a slash ends void elements only
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close_to(i)
                return
            # an inline end tag does not reach out of its block
            if self.open[i][1] is not None and tag not in BLOCK and tag not in UNSEEN:
                return

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(data)
            self.linked += len(data) if self.links else 0


def parse(html: str) -> list[Node]:
    """Block tree of a page, whatever its faults."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    builder.close_to(0)
    builder.end_run()
    return builder.nodes


GROUPS = ("article main", "section", "div", "p", "h1 h2 h3", "h4 h5 h6", "ul ol dl menu li dt dd", "nav", "header hgroup", "footer", "aside", "form fieldset search dialog", "table thead tbody tfoot tr td th caption", "blockquote pre figure", "address details summary", "#text", "html body #root")
OF_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
#: Kinds of ancestors that a node is told of.
ABOVE = (0, 7, 8, 9, 10, 11)
HASHED = 16


def features(nodes: list[Node]) -> np.ndarray:
    """A row per node: kind, attribute words (own and of ancestors), depth, subtree density and sibling statistics."""
    n = len(nodes)
    leaf = [node.tag == "#text" for node in nodes]
    chars = [len(node.text) for node in nodes]
    linked = [node.linked for node in nodes]
    marks = [sum(map(node.text.count, ".,;:!?")) if node.text else 0 for node in nodes]
    tags, runs = [int(not x) for x in leaf], list(map(int, leaf))
    for i in range(n - 1, 0, -1):
        at = nodes[i].parent
        chars[at] += chars[i]
        linked[at] += linked[i]
        marks[at] += marks[i]
        tags[at] += tags[i]
        runs[at] += runs[i]
    group = [OF_GROUP.get(node.tag, 2) for node in nodes]
    hashed = np.zeros((n, HASHED))
    own = np.zeros((n, 2))
    for i, node in enumerate(nodes):
        for w in node.attributes:
            hashed[i, zlib.crc32(w.encode()) % HASHED] = 1.0
            own[i, 0] += w in GOOD
            own[i, 1] += w in BAD
    kind = np.zeros((n, len(GROUPS)))
    kind[np.arange(n), group] = 1.0
    # what a node and its ancestors add up to
    path = np.column_stack([own, kind[:, list(ABOVE)]])
    siblings, before, behind = [1] * n, [0] * n, [0] * n
    for i in range(1, n):
        node = nodes[i]
        path[i] += path[node.parent]
        up = nodes[node.parent].children
        siblings[i] = len(up)
        if node.place:
            before[i] = chars[up[node.place - 1]]
        if node.place + 1 < len(up):
            behind[i] = chars[up[node.place + 1]]
    parent = np.array([max(node.parent, 0) for node in nodes])
    chars, linked, marks, tags, runs = (np.array(v, float) for v in (chars, linked, marks, tags, runs))
    some, place = np.maximum(chars, 1), np.array([node.place for node in nodes], float)
    rest = (
        [node.depth for node in nodes], [len(node.children) for node in nodes], place / siblings, np.log1p(siblings), np.log1p(chars), chars / some[0],
        chars / some[parent], linked / some, marks / some, np.log1p(marks), tags / some, chars / np.maximum(runs, 1), np.log1p(before), np.log1p(behind),
        np.array(group)[parent],
    )
    return np.column_stack([kind, hashed, own, path, *rest])


def number_siblings(nodes: list[Node]) -> list[Node]:
    for node in nodes:
        for k, c in enumerate(node.children):
            nodes[c].place = k
    return nodes


def tree_of(html: str | None) -> list[Node]:
    return number_siblings(parse(html or ""))


def chosen(nodes: list[Node], value: np.ndarray) -> list[bool]:
    """The consistent choice of nodes with the greatest total value: a child only with its parent. The root is always in."""
    best = value.tolist()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = [True] * len(nodes)
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].parent] and best[i] > 0
    return keep


@dataclass
class Forest:
    """Regression trees as arrays: for each inner node its feature, threshold and two followers; leaves hold values."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Twice the weighted sum of the trees: the log-odds of the boosted classifier."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root, weight in zip(self.roots, self.weights):
            at = np.full(len(x), root)
            while True:
                inner = self.feature[at] >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
                at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
            total += weight * self.value[at]
        return 2 * total


def as_arrays(model) -> Forest:
    """The trees of a fitted ``GBTClassificationModel``."""
    rows: list[list] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, 0, 0, node.prediction()])
        if node.subtreeDepth() > 0:
            split = node.split()
            rows[at][:2] = [split.featureIndex(), split.threshold()]
            rows[at][2:4] = [add(node.leftChild()), add(node.rightChild())]
        return at

    roots = [add(tree._java_obj.rootNode()) for tree in model.trees]
    columns = list(zip(*rows))
    return Forest(*(np.array(c) for c in columns), np.array(roots), np.array(model.treeWeights))


def is_main(nodes: list[Node]) -> np.ndarray:
    """What the markup itself says, where it names the article: text inside ``article`` or ``main`` and outside of whatever
    is named otherwise, with the containers of such text. These are the labels that the fit learns from."""
    named = np.zeros(len(nodes), bool)
    out = np.zeros(len(nodes), bool)
    for i, node in enumerate(nodes[1:], 1):
        excluded = OF_GROUP.get(node.tag) in (7, 8, 9, 10, 11) or any(w in BAD for w in node.attributes)
        named[i] = (named[node.parent] or node.tag in ("article", "main")) and not excluded
        if node.tag == "#text" and named[i]:
            at = i
            while at > 0 and not out[at]:
                out[at] = True
                at = node.parent if at == i else nodes[at].parent
    return out


MAIN_NAMES = ("post-content", "entry", "article-body", "story", "content", "post", "main-text")
OTHER = (
    ("nav", ""), ("header", ""), ("footer", ""), ("aside", ""), ("form", ""), ("div", "sidebar"), ("div", "ad"), ("div", "advert banner"), ("div", "comments"), ("section", "comment-list"),
    ("ul", "menu"), ("div", "cookie-notice"), ("div", "newsletter-signup"), ("div", "related"), ("div", "share-links"), ("div", "promo"), ("div", "breadcrumbs"), ("section", "comments"),
)


def variants(nodes: list[Node], seed: int) -> list[tuple[list[Node], np.ndarray]]:
    """The page's tree with its labels, and the same texts laid out under other names, so that the fit does not hang on one
    template: the main text in an article, a main or a named div, surrounded and interrupted by named boilerplate."""
    main = is_main(nodes)
    rng = np.random.default_rng(seed)
    texts = [n.text for n, y in zip(nodes, main) if y and n.tag == "#text"]
    rest = [n.text for n, y in zip(nodes, main) if not y and n.tag == "#text"] or ["..."]
    if not texts:
        return []
    out = [(nodes, main)]
    made = [Node("#root", -1, 0)]
    labels = [True]

    def add(parent: int, tag: str, words: tuple = (), text: str = "", y: bool = False, linked: int = 0) -> int:
        made[parent].children.append(len(made))
        made.append(Node(tag, parent, made[parent].depth + 1, words, [], text, linked))
        labels.append(y)
        return len(made) - 1

    def other(parent: int) -> None:
        tag, name = OTHER[rng.integers(len(OTHER))]
        box = add(parent, tag, tuple(name.replace("-", " ").split()))
        prose = "comment" in name or rng.random() < 0.2
        for _ in range(rng.integers(1, 6)):
            text = texts[rng.integers(len(texts))] if prose else rest[rng.integers(len(rest))]
            inner = add(box, "li" if tag in ("nav", "ul") else "p" if rng.random() < 0.7 else "div")
            add(inner, "#text", (), text, False, len(text) if not prose and rng.random() < 0.6 else 0)

    at = 0
    for tag in ("html", "body", *["div"] * rng.integers(0, 3)):
        at = add(at, tag, (), "", True)
    for _ in range(rng.integers(1, 4)):
        other(at)
    kind = rng.integers(3)
    body = add(at, ("article", "main", "div")[kind], () if kind < 2 else tuple(MAIN_NAMES[rng.integers(len(MAIN_NAMES))].split("-")), "", True)
    for text in texts:
        if rng.random() < 0.08:
            other(body)
        tag = rng.choice(["p", "p", "p", "h2", "li", "div", "blockquote"])
        outer = add(body, "ul", (), "", True) if tag == "li" else body
        add(add(outer, str(tag), (), "", True), "#text", (), text, True)
    for _ in range(rng.integers(1, 4)):
        other(at)
    return [*out, (number_siblings(made), np.array(labels))]


#: Made-up pages beside the sample.
EXAMPLES = 24


def example(seed: int) -> str:
    """A page of made-up sentences that names its article."""
    rng = np.random.default_rng(seed)

    def words(n: int) -> str:
        return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))

    prose = "".join(f"<p>{'. '.join(words(int(rng.integers(4, 18))).capitalize() for _ in range(rng.integers(1, 6)))}.</p>" for _ in range(rng.integers(2, 9)))
    menu = "".join(f"<li><a href=/>{words(int(rng.integers(1, 4)))}</a></li>" for _ in range(rng.integers(3, 9)))
    head, foot = f"<header><p>{words(3)}</p></header><nav><ul>{menu}</ul></nav>", f"<footer><p>{words(4)}</p></footer>"
    return f"<body>{head}<article><h1>{words(5)}</h1>{prose}</article><aside><h2>{words(2)}</h2><p>{words(8)}</p></aside>{foot}</body>"


#: Pages that name their article, whatever else they hold.
NAMED = r"(?i)<(article|main)[\s>/]"


def training_rows(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """``(features, label)`` of the nodes of up to ``SAMPLE`` different pages whose markup names its article, the first by a
    hash of their text, and of ``EXAMPLES`` made-up pages, so that there is a model where no page names its article."""
    named = pages.select(F.col(html).cast("string").alias("html")).where(F.col("html").rlike(NAMED)).select(F.xxhash64("html").alias("h"), "html")
    first = named.select("h").distinct().orderBy("h").limit(SAMPLE)
    # copies of a page meet after one is left of them in each task
    sample = named.join(first, "h", "left_semi").dropDuplicates(["h"])
    given = pages.sparkSession.createDataFrame([(seed, example(seed)) for seed in range(EXAMPLES)], "h long, html string")
    sample = sample.unionAll(given)
    spread = sample.repartition(8, "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for nodes, labels in variants(tree_of(page), seed & 0xFFFFFFFF):
                    x = features(nodes)[1:]
                    lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                    yield pa.RecordBatch.from_arrays([lists, pa.array(labels[1:].astype(float))], names=["x", "label"])

    return spread.mapInArrow(run, "x array<double>, label double")


def fit(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> Forest | None:
    """Trees from a bounded sample of the pages whose markup names its article and from the made-up ones. Tables without
    such a page, empty ones too, give the trees of the made-up pages alone."""
    rows = stored(training_rows(pages, id_col, html))
    seen = rows.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
    if seen.a is None or seen.a == seen.b:
        return None
    model = GBTClassifier(featuresCol="f", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED, maxBins=32)
    return as_arrays(model.fit(rows.select(array_to_vector("x").alias("f"), "label")))


#: Nodes that are judged together.
TOGETHER = 20_000


def main_texts(pages: list[str | None], forest: Forest | None) -> list[str]:
    """Main text of each page: its chosen blocks in page order, two newlines between them."""
    out: list[str] = []
    held: list[list[Node]] = []

    def judge() -> None:
        if forest:
            values = forest.log_odds(np.concatenate([features(nodes) for nodes in held]))
        else:
            values = np.concatenate([np.where(is_main(nodes), 1.0, -1.0) for nodes in held])
        ends = np.cumsum([len(nodes) for nodes in held])
        for nodes, own in zip(held, np.split(values, ends[:-1])):
            keep = chosen(nodes, own)
            out.append("\n\n".join(n.text for n, k in zip(nodes, keep) if k and n.tag == "#text"))
        held.clear()

    size = 0
    for page in pages:
        held.append(tree_of(page))
        size += len(held[-1])
        if size > TOGETHER:
            judge()
            size = 0
    if held:
        judge()
    return out


def with_main_text(pages: DataFrame, forest: Forest | None, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the main text of the whole page, empty if none (null and empty pages included). A column
    ``out`` is replaced. One narrow pass; a task holds the tree of one page at a time."""
    kept = [c for c in pages.columns if c != out]
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField(out, T.StringType())])
    source = pages.select(*kept, F.col(html).cast("string").alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = main_texts(batch.column(len(kept)).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=schema.fieldNames())

    return source.mapInArrow(run, schema)
