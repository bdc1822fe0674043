"""Main text of web pages by a site style tree.

Pages of a host are merged into one tree of style nodes: paths of block elements with their classes and
ids. A node's presentation counts by the entropy of the child sequences that its pages show, the content that
stands in it by how few of the pages share its texts. On a page, a node's importance is made of its presentation
and, the more so the fewer styles it has, of the mean importance of what it holds: its texts and its child nodes. A
node whose importance, and that of all nodes in it, is low is removed.

What elements say of themselves is a prior that importance is multiplied by. Elements that are menus, footers,
adverts, forms or comments by name, role or a whole class or id count 0. Layout words that themes also put on what
holds an article ("sidebar", "widget", "header", ...) count WEAK. A class or id is such a word, or words joined
that are all of this kind or plain layout words ("cookie-notice", "site-footer"; not "related-work", "has-sidebar").
No prior comes from html or body, nor from the classes and ids of main, nor from those of an article where the page has no other one and no more
text outside than in it, unless they call it a comment. Attributes are read one after another, so that words in the value of one are never another. Where a page marks its article outside such elements, only that is kept; there all
that isn't marked otherwise counts as important, so a text that the host's pages share stays, and importance decides
on elements with layout words. An article that stands in elements with layout words alone is an article, too.

Each page is parsed once, and what was found is written. The tree is made of all pages, and every page's text comes by the importance of
its nodes; marks and priors are checked on that. Counts are aggregated before any shuffle, so that a host of any size is spread. Up to FEW_NODES
style nodes, counted, go to every task; more are joined, salted, with the nodes of pages, and never with their html.

Cases: null and empty pages, and pages without such text, give an empty text; null urls share one nameless
host; repeated rows are extracted each by itself and counted each; broken markup is read as far as it goes, and
elements may be nested to any depth: a node costs the same wherever it stands; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

LEAST_IMPORTANCE, LEAST_PAGES, DECAY = 0.2, 5, 0.9
WEAK, UNKNOWN = 0.25, 0.5
SALT = 16
#: So many style nodes of all hosts, counted, are sent to every task: 24 bytes and a host's name each.
FEW_NODES = 1 << 16

#: Names of elements and words of classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe select object button".split())
INLINE_RAW = frozenset("select button".split())
FOREIGN = frozenset("svg math".split())
TO_THE_END = frozenset("script style".split())
BLOCKS = frozenset("html body p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption section article main header footer nav aside blockquote pre figure figcaption form fieldset address details summary center menu dialog head".split())
NOISE = frozenset("head nav footer aside form menu dialog".split())
NOISE_WORDS = frozenset("nav navbar navigation menu footer aside cookie cookies consent gdpr notice notices ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion comment comments disqus replies newsletter subscribe subscription share sharing related recommended breadcrumb breadcrumbs pagination pager popup login signup contentinfo complementary".split())
COMMENT_WORDS = frozenset("comment comments disqus replies".split())
WEAK_WORDS = frozenset("header sidebar widget banner social search hidden overlay modal masthead".split())
LAYOUT_WORDS = frozenset("area bar block bottom box buttons column container content group inner item items left links list main outer page panel primary region right secondary section site slot top unit wrap wrapper".split())
ARTICLE = frozenset("article main".split())
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "head"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
#: A name, which may hold quotes, and a value in quotes or without.
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?|=")
TOLD = frozenset("class id role itemprop hidden aria-hidden style".split())
PARTS = re.compile(r"[^a-z0-9]+")
NUMBER = re.compile(r"\d+")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Raw elements within a line end with the block that they stand in, at the latest.
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?![\w-])", re.I)


def number(*parts: int | str) -> int:
    """A signed 64-bit hash of a text, or of a path's number and a label."""
    import xxhash

    value = xxhash.xxh64_intdigest("/".join(map(str, parts)).encode("utf-8", "replace"))
    return value - (1 << 64) if value >> 63 else value


def path_of(*labels: str) -> int:
    """The number of the path through elements with these labels."""
    path = 0
    for label in labels:
        path = number(path, label)
    return path


def prior_of(token: str) -> float:
    """What one whole class or id says: 0 for what isn't the page's text, WEAK for a layout word, else 1."""
    parts = [p for p in PARTS.split(token) if p]
    if not parts or not all(p in NOISE_WORDS or p in WEAK_WORDS or p in LAYOUT_WORDS or p.isdigit() for p in parts):
        return 1.0
    return 0.0 if any(p in NOISE_WORDS for p in parts) else WEAK if any(p in WEAK_WORDS for p in parts) else 1.0


@dataclass
class Page:
    """A parsed page: its nodes in the order of their start, and the blocks of text in page order."""

    parent: list[int] = field(default_factory=lambda: [-1])
    path: list[int] = field(default_factory=lambda: [0])
    name: list[str] = field(default_factory=lambda: [""])
    prior: list[float] = field(default_factory=lambda: [1.0])  #: the node's own, but for its classes and ids
    named: list[float] = field(default_factory=lambda: [1.0])  #: that of its classes and ids
    comment: list[bool] = field(default_factory=lambda: [False])  #: they call it a comment
    marks: list[bool] = field(default_factory=lambda: [False])  #: it says that it is the article
    kids: list[list[str]] = field(default_factory=lambda: [[]])
    blocks: list[tuple[int, str]] = field(default_factory=list)

    def add(self, parent: int, name: str, attributes: str) -> int:
        label, prior, marks, named, comment = name, 0.0 if name in NOISE else 1.0, name in ARTICLE, 1.0, False
        seen = set()
        for m in ATTRIBUTE.finditer(attributes) if attributes else ():
            key = (m[1] or "").lower()
            if key not in TOLD or key in seen:
                continue
            seen.add(key)
            value = references.unescape(m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                named = min([named, *map(prior_of, value.split())])
                comment = comment or not COMMENT_WORDS.isdisjoint(PARTS.split(value))
                label += "." + NUMBER.sub("0", ".".join(value.split()))
            if key == "role":
                prior = min([prior, *map(prior_of, value.split())])
            if key == "role" and value.strip() in ARTICLE or key == "itemprop" and "articlebody" in value.split():
                marks = True
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                prior = 0.0
        self.parent.append(parent)
        self.path.append(number(self.path[parent], label))
        self.name.append(name)
        self.prior.append(1.0 if name in ("html", "body") else prior)
        self.named.append(1.0 if name in ("html", "body", "main") else named)
        self.comment.append(comment)
        self.marks.append(marks)
        self.kids.append([])
        if not self.kids[parent] or self.kids[parent][-1] != name:
            self.kids[parent].append(name)
        return len(self.parent) - 1

    def own_words_apart(self) -> list[int]:
        """Nodes that mark the article and whose classes and ids don't count: no other node marks it without such words, and no more text stands outside."""
        marked = [i for i, marks in enumerate(self.marks) if marks and self.name[i] != "main" and self.prior[i] == 1.0]
        if not marked or any(self.named[i] == 1.0 for i in marked):
            return []
        found = [i for i in marked if not self.comment[i]]
        held, kept = [0] * len(self.parent), set(found)
        around, inside = [1.0] * len(self.parent), [False] * len(self.parent)
        for i in range(1, len(self.parent)):
            inside[i] = inside[self.parent[i]] or i in kept
            around[i] = min(around[self.parent[i]], self.prior[i], 1.0 if i in kept else self.named[i])
        for node, text in self.blocks:
            held[node] += len(text)
        within = sum(n for n, a, x in zip(held, around, inside, strict=True) if x and a > 0)
        return found if 2 * within >= sum(n for n, a in zip(held, around, strict=True) if a > 0) else []

    def judged(self) -> list[float | None]:
        """For each node its prior with those around it, None where its text is kept whatever its importance."""
        n = len(self.parent)
        priors = [min(own, named) for own, named in zip(self.prior, self.named, strict=True)]
        for i in self.own_words_apart():
            priors[i] = self.prior[i]
        around, clean = [1.0] * n, [False] * n
        for i in range(1, n):  # parents come first
            up = self.parent[i]
            own = 0.0 if self.name[i] == "header" and not clean[up] else priors[i]  # a header outside is the site's
            around[i] = min(around[up], own)
            clean[i] = clean[up] or (self.marks[i] and around[i] == 1.0)
        if not any(clean):  # an article that stands in elements with layout words alone
            inside = [False] * n
            for i in range(1, n):
                up = self.parent[i]
                if not inside[up] and self.marks[i] and around[i] > 0 and priors[i] == 1.0:
                    inside[i] = clean[i] = True
                    around[i] = 1.0
                elif inside[up]:
                    inside[i] = clean[i] = True
                    around[i] = min(around[up], priors[i])
        if any(clean):
            return [(None if a == 1.0 else a) if c else 0.0 for a, c in zip(around, clean, strict=True)]
        return around


def parse(html: str | None) -> Page:
    page, html = Page(), html or ""
    stack, open_, parts, at = [0], Counter(), [], 0
    endless: set[str] = set()  # of these no end follows

    def flush() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            parts.clear()
            if text:
                page.blocks.append((stack[-1], text))

    def close() -> None:
        open_[page.name[stack.pop()]] -= 1

    while at < len(html):
        m = TOKEN.search(html, at)
        if m is None:
            parts.append(html[at:])
            break
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name in BLOCKS:
                flush()
                if open_[name] > 0:
                    while page.name[stack[-1]] != name:
                        close()
                    close()
            continue
        if name in RAW:
            if name in FOREIGN and (m[3] or "").rstrip().endswith("/"):
                continue
            end = None if name in endless else RAW_END[name].search(html, at)
            if end is not None:
                block = BLOCK_TAG.search(html, at, end.start()) if name in INLINE_RAW else None
                at = end.end() if block is None else block.start()
            elif name in TO_THE_END:
                break
            else:
                endless.add(name)
            continue
        if name in ("br", "hr"):
            flush()
            continue
        if name in VOID or name not in BLOCKS:
            continue
        flush()
        top = page.name[stack[-1]]
        if top == "p" and name in ENDS_PARAGRAPH or name in ("li", "td", "th", "tr", "dt", "dd") and top == name:
            close()
        stack.append(page.add(stack[-1], name, m[3] or ""))
        open_[name] += 1
    flush()
    return page


def importances(parent: np.ndarray, known: list[tuple[float, float, float | None] | None], texts: list[int], decay: float = DECAY) -> np.ndarray:
    """The importance of each node of a page, from the bottom up.

    known has for each node its presentation, its number of styles and the importance of texts in it, as its host has them, or None where the
    host has too few such pages. texts has the node of each block of text.
    """
    n = len(parent)
    held, things, out = np.zeros(n), np.zeros(n), np.full(n, UNKNOWN)
    for node in texts:
        content = known[node][2] if known[node] else None
        held[node] += UNKNOWN if content is None else content
        things[node] += 1
    for i in range(n - 1, -1, -1):
        mean = held[i] / things[i] if things[i] else None
        if known[i]:
            presentation, styles, _ = known[i]
            part = decay**styles
            out[i] = (1 - part) * presentation + part * (1.0 if mean is None else mean)
        elif mean is not None:
            out[i] = mean
        if i and parent[i] >= 0:
            held[parent[i]] += out[i]
            things[parent[i]] += 1
    return out


def low_nodes(parent: np.ndarray, prior: np.ndarray, importance: np.ndarray, least: float = LEAST_IMPORTANCE) -> np.ndarray:
    """Nodes that are low, with all that is in them; a prior of NaN keeps a node."""
    low = np.where(np.isnan(prior), False, np.nan_to_num(prior) * importance < least)
    gone = low & (np.nan_to_num(prior, nan=1.0) == 0)  # what a prior of 0 covers goes whatever it holds
    for i in range(len(parent) - 1, 0, -1):
        if not low[i]:
            low[parent[i]] = False
    return low | gone


def kept_text(parent: list[int], prior: list[float | None], known: list[tuple | None], nodes: list[int], texts: list[str], least: float = LEAST_IMPORTANCE) -> str:
    """The blocks of text in nodes that aren't low, given what the host knows of each node."""
    up = np.array(parent)
    low = low_nodes(up, np.array([np.nan if p is None else p for p in prior], float), importances(up, known, nodes), least)
    return "\n".join(text for node, text in zip(nodes, texts, strict=True) if not low[node])


def main_text(html: str | None, known: dict[int, tuple[float, float, float | None]] | None = None, least: float = LEAST_IMPORTANCE) -> str:
    """The main text of one page, given what its host knows of paths."""
    page = parse(html)
    return kept_text(page.parent, page.judged(), [(known or {}).get(p) for p in page.path], [n for n, _ in page.blocks], [t for _, t in page.blocks], least)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


LONGS, KIND = pa.list_(pa.int64()), T.ArrayType(T.LongType())
#: What is written of a page besides the columns asked for: for the tree the distinct (path, children) and (path, text); its nodes and blocks.
PARSED = {
    "style_path": (LONGS, KIND), "style": (LONGS, KIND), "text_path": (LONGS, KIND), "text_hash": (LONGS, KIND),
    "node_path": (LONGS, KIND), "node_parent": (LONGS, KIND), "node_prior": (pa.list_(pa.float64()), T.ArrayType(T.DoubleType())), "block_node": (LONGS, KIND), "block_text": (pa.list_(pa.string()), T.ArrayType(T.StringType())),
}


def parsed(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """One row for each page: `keep` as __keep0, ..., __host, and the columns of PARSED, with __ before their names."""
    source = pages.select(*[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)], host_of(F.col("url")).alias("__host"), F.col("html").alias("__html"))
    kept = [c for c in source.columns if c != "__html"]
    schema = T.StructType([source.schema[c] for c in kept])
    for name, (_, kind) in PARSED.items():
        schema = schema.add(f"__{name}", kind)

    def row(html: str | None) -> dict:
        page = parse(html)
        styles = list({(p, number(",".join(k))): 0 for p, k in zip(page.path[1:], page.kids[1:], strict=True)})
        texts = list({(page.path[node], number(text)): 0 for node, text in page.blocks})
        out = {"style_path": [p for p, _ in styles], "style": [h for _, h in styles], "text_path": [p for p, _ in texts], "text_hash": [h for _, h in texts]}
        return out | {"node_path": page.path, "node_parent": page.parent, "node_prior": page.judged(), "block_node": [n for n, _ in page.blocks], "block_text": [t for _, t in page.blocks]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [row(x) for x in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *[pa.array([r.get(name) for r in rows], kind) for name, (kind, _) in PARSED.items()]], names=schema.names)

    return source.mapInArrow(run, schema)


def style_tree(found: DataFrame, decay: float = DECAY) -> DataFrame:
    """(host, path, pages, presentation, styles, content) of the style nodes that at least LEAST_PAGES pages have, from the rows of `parsed`."""
    each = lambda kind, path, other: found.select(F.col("__host").alias("host"), F.lit(kind).alias("kind"), F.explode(F.arrays_zip(F.col(path).alias("p"), F.col(other).alias("h"))).alias("x")).select("host", F.col("x.p").alias("path"), "kind", F.col("x.h").alias("h"))
    shown = each("style", "__style_path", "__style").unionByName(each("text", "__text_path", "__text_hash"))
    there = found.select(F.col("__host").alias("host"), F.explode(F.array_distinct("__style_path")).alias("path"), F.lit("page").alias("kind"), F.lit(0).cast("long").alias("h"))
    summed = shown.unionByName(there).groupBy("host", "path", "kind", "h").agg(F.count("*").alias("n"))
    # Entropies come apart into sums over styles and texts, so a host's tree is added up before it meets in a task.
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    n = F.col("n").cast("double")
    sums = summed.groupBy("host", "path").agg(
        F.max(of("page", n)).alias("pages"), F.sum(of("style", n * F.log(n))).alias("n_log_n"), F.sum(of("style", n)).alias("shown"), F.count(of("style", n)).cast("double").alias("styles"), F.avg(of("text", F.log(n))).alias("log_n")
    )
    m = F.log("pages")
    presentation = F.coalesce((F.col("shown") * m - F.col("n_log_n")) / (F.col("pages") * m), F.lit(0.0))
    return sums.where(F.col("pages") >= LEAST_PAGES).select("host", "path", "pages", presentation.alias("presentation"), "styles", (1 - F.col("log_n") / m).alias("content"))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), least: float = LEAST_IMPORTANCE, few: int = FEW_NODES) -> DataFrame:
    """The columns `keep` of pages, and the text of each."""
    own = staged(parsed(pages, keep), "pages")
    tree = staged(style_tree(own), "tree")
    names = [f"__keep{i}" for i in range(len(keep))]
    schema = T.StructType([own.schema[c] for c in names]).add("__text", T.StringType())
    parts = ["__node_parent", "__node_prior", "__block_node", "__block_text"]
    sent = None
    if tree.count() <= few:
        hosts: dict[str, dict[int, tuple]] = {}
        for host, path, *told in tree.select("host", "path", "presentation", "styles", "content").collect():
            hosts.setdefault(host, {})[path] = tuple(told)
        sent = pages.sparkSession.sparkContext.broadcast(hosts)
        given, parts = own, [*parts, "__host", "__node_path"]
    else:
        rows = own.withColumn("__row", F.monotonically_increasing_id())
        salt = F.pmod(F.xxhash64("__row"), F.lit(SALT))
        nodes = rows.select("__row", "__host", salt.alias("__salt"), F.posexplode("__node_path").alias("__at", "__path"))
        spread = tree.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "presentation", "styles", "content", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<long>")).alias("__salt"))
        known = nodes.join(spread, ["__host", "__path", "__salt"]).groupBy(F.col("__row").alias("__r")).agg(F.collect_list(F.struct("__at", "presentation", "styles", "content")).alias("__known"))
        given, parts = rows.join(known, rows["__row"] == known["__r"], "left"), [*parts, "__known"]

    def knows(r: dict) -> list[tuple | None]:
        if sent is not None:
            paths = sent.value.get(r["__host"], {})
            return [paths.get(p) for p in r["__node_path"]]
        found: list[tuple | None] = [None] * len(r["__node_parent"])
        for k in r["__known"] or ():
            found[k["__at"]] = (k["presentation"], k["styles"], k["content"])
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = batch.select(parts).to_pylist()
                texts = [kept_text(r["__node_parent"], r["__node_prior"], knows(r), r["__block_node"], r["__block_text"], least) for r in rows]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], names=schema.names)

    told = given.select(*names, *parts).mapInArrow(run, schema)
    return told.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], F.col("__text").alias("text"))
