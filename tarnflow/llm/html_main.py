"""Main text of web pages with a tree-structured graphical model.

The block elements of a page form a tree. Every node has a hidden label, content or
not; potentials on nodes come from their features, potentials on edges from how labels of
parents and children go together. Sum-product messages up and down the tree give
each node the exact marginal probability of being content.

Potentials are trained from labelled pages: those of a bounded sample that mark their
article themselves (``article`` or ``main``), with the marked part as content except
for the parts in it whose names say otherwise.
"""

from __future__ import annotations

import html as html_text
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import map_batches, table
from tarnflow.llm.html_tokens import tokens

#: Pages of the training sample, on average; twice as many at most.
SAMPLE_PAGES = 2000
CONTENT_AT = 0.5
RAW = frozenset("script style template noscript textarea title svg iframe object select".split())
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
#: Elements that hold text within a line; they are no nodes and break no block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Starts of these end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Starts of these end an open element of the same family.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl nav article section div body html".split())
#: Names that speak for or against content: labels of the training pages and prior counts.
CONTENT_TAGS = frozenset({"article", "main"})
OTHER_TAGS = frozenset("nav header footer aside form menu dialog button fieldset select".split())
OTHER_NAMES = frozenset(
    "ad ads advert advertisement sponsor sponsored promo banner nav navbar menu breadcrumb breadcrumbs sidebar side header footer cookie cookies consent notice notices alert popup modal"
    " newsletter subscribe signup login share social related recommended comment comments reply replies disqus respond widget toolbar pagination pager copyright legal".split()
)
PRIOR = 40.0
MARKS = CONTENT_TAGS | OTHER_TAGS | OTHER_NAMES
#: Largest weight of one feature, so that no single one outvotes all others.
LIMIT = 4.0


class Page:
    """Block elements in document order, and text blocks with the element that holds them.

    Text outside any block element is a paragraph of an implied body.
    """

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.names = ["#root"], [-1], [()]
        self.lengths, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        self._text: list[str] = []
        self._body = 0
        self._read(source)

    def _open(self, tag: str, parent: int, names: tuple[str, ...] = ()) -> int:
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.lengths.append(0)
        self.linked.append(0)
        return len(self.tags) - 1

    def _paragraph(self) -> int:
        self._body = self._body or self._open("body", 0)
        return self._open("p", self._body)

    def _flush(self, node: int) -> None:
        if self._text:
            block = " ".join(html_text.unescape("".join(self._text)).split())
            self._text.clear()
            if block:
                if not node:
                    node = self._paragraph()
                    for sizes in (self.lengths, self.linked):
                        sizes[node], sizes[0] = sizes[0], 0
                self.blocks.append((node, block))

    def _read(self, source: str) -> None:
        stack, links = [0], 0
        for text, tag, end, attributes in tokens(source, RAW):
            if text is not None:
                self._text.append(text)
                size = len(text)
                self.lengths[stack[-1]] += size
                if links:
                    self.linked[stack[-1]] += size
                continue
            if tag == "a":
                links = 0 if end else 1
                continue
            if tag == "br":
                self._text.append(" ")
                continue
            if tag in INLINE:
                continue
            self._flush(stack[-1])
            if end:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == tag:
                        del stack[k:]
                        links = 0
                        break
                continue
            if tag in ENDS_P and self.tags[stack[-1]] == "p":
                stack.pop()
            family = SIBLINGS.get(tag)
            if family:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] in family:
                        del stack[k:]
                        break
                    if self.tags[stack[k]] in SCOPES:
                        break
            if tag in VOID:
                continue
            names = tuple(dict.fromkeys(w for m in _NAMES.finditer(attributes) for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()))) if attributes else ()
            stack.append(self._open(tag, stack[-1], names))
        self._flush(stack[-1])

    def features(self) -> list[list[str]]:
        """Names of the features of every node."""
        lengths, linked = self.lengths[:], self.linked[:]
        for k in range(len(lengths) - 1, 0, -1):
            lengths[self.parents[k]] += lengths[k]
            linked[self.parents[k]] += linked[k]
        found = []
        marks: list[tuple[str, ...]] = []
        for k, tag in enumerate(self.tags):
            up = self.tags[self.parents[k]] if k else ""
            over = marks[self.parents[k]] if k else ()
            own = [m for m in (tag, *self.names[k]) if m in MARKS]
            marks.append(tuple(dict.fromkeys([*over, *own])) if own else over)
            size, share = lengths[k].bit_length() // 2, linked[k] * 4 // max(1, lengths[k])
            found.append([f"tag={tag}", f"up={up}>{tag}", f"size={size}", f"links={share}", *[f"name={n}" for n in self.names[k]], *[f"under={m}" for m in over]])
        return found

    def own_labels(self) -> list[int] | None:
        """Labels by the page's own marks, None if it marks no article."""
        if not any(t in CONTENT_TAGS for t in self.tags):
            return None
        labels: list[int] = []
        barred: list[bool] = []
        for k, tag in enumerate(self.tags):
            up = self.parents[k]
            bar = (k > 0 and barred[up]) or tag in OTHER_TAGS or not OTHER_NAMES.isdisjoint(self.names[k])
            barred.append(bar)
            labels.append(int(not bar and (tag in CONTENT_TAGS or (k > 0 and labels[up] == 1))))
        return labels


class TreeModel:
    """Log potentials of nodes and edges."""

    def __init__(self, counts: dict[str, tuple[float, float]]) -> None:
        cells = {k: list(v) for k, v in counts.items()}
        other = [f"tag={t}" for t in OTHER_TAGS] + [f"name={n}" for n in OTHER_NAMES] + [f"under={m}" for m in OTHER_TAGS | OTHER_NAMES]
        for names, column in (([f"tag={t}" for t in CONTENT_TAGS], 1), (other, 0)):
            for name in names:
                cells.setdefault(name, [0.0, 0.0])[column] += PRIOR
        no, yes = cells.pop("#nodes", [0.0, 0.0])
        total = math.log((yes + 1) / (no + 1))
        self.weights = {name: max(-LIMIT, min(LIMIT, math.log((c[1] + 0.5) / (c[0] + 0.5)) - total)) for name, c in cells.items() if not name.startswith("#")}
        edges = [cells.get(f"#edge{p}", [0.0, 0.0]) for p in (0, 1)]
        start = [[8.0, 2.0], [2.0, 8.0]]
        self.edges = [[math.log((edges[p][c] + start[p][c]) / (sum(edges[p]) + 10.0)) for c in (0, 1)] for p in (0, 1)]
        root = cells.get("#root", [0.0, 0.0])
        self.root = math.log((root[1] + 0.5) / (root[0] + 0.5))

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of every node, by messages up and then down the tree."""
        weights, parents, n = self.weights, page.parents, len(page.tags)
        (e00, e01), (e10, e11) = self.edges
        own = [max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in fs))) for fs in page.features()]
        own[0] += self.root
        # Messages are log odds: what the subtree says about a node, and about its parent.
        inner, up = own[:], [0.0] * n
        for k in range(n - 1, 0, -1):
            up[k] = _log_add(e10, e11 + inner[k]) - _log_add(e00, e01 + inner[k])
            inner[parents[k]] += up[k]
        belief = inner[:]
        for k in range(1, n):
            rest = belief[parents[k]] - up[k]
            belief[k] += _log_add(e01, e11 + rest) - _log_add(e00, e10 + rest)
        return [1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, b)))) for b in belief]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def main_text(source: str, model: TreeModel) -> str:
    """Blocks of content, in page order."""
    page = Page(source)
    share = model.marginals(page)
    return "\n\n".join(text for node, text in page.blocks if share[node] >= CONTENT_AT)


def _count(pages: list[str]) -> Counter:
    counts: Counter = Counter()
    for source in pages:
        page = Page(source)
        labels = page.own_labels()
        if labels is None:
            continue
        for k, names in enumerate(page.features()):
            label = labels[k]
            counts["#nodes", label] += 1
            counts["#root" if k == 0 else f"#edge{labels[page.parents[k]]}", label] += 1
            for name in names:
                counts[name, label] += 1
    return counts


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> TreeModel:
    """Count labels with features and edges over the training pages.

    The sample is drawn by a hash of the id at a rate that gives ``sample_pages`` pages;
    counting runs where the pages are, only sums of features reach the driver.
    """
    total = pages.count()
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = pages.where(drawn < min(1.0, sample_pages / max(1, total))).where(F.col(html_col).isNotNull()).select(F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _count(batch.column("html").to_pylist())
            keys = list(counts)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "label", "n"])

    summed = map_batches(chosen, run, "name string, label int, n long").groupBy("name").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("no"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("yes")
    )
    return TreeModel({r["name"]: (float(r["no"]), float(r["yes"])) for r in summed.collect()})


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per row.

    Text is empty for null or empty pages and for those without content. Repeated rows each
    give a row; other columns are ignored; no rows give no rows. One pass, no shuffle.
    """
    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = dict(narrow.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "", model) for h in batch.column("html")]
            columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return map_batches(narrow, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op9(spark, sf_dir):
    """Extracts the main text of all ``pages``; see :func:`extract`."""
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
