import html as references
import math
import os
import re
from itertools import groupby
from xml.etree import ElementTree

import numpy as np
import pytest

from scriptorium.llm import html_text as H
from scriptorium.llm import maxscore as M


def brute(rows, every=50, k=5):
    """The sorted answers: every row whose id is divisible by `every` asks all other rows."""
    clean = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, own) in enumerate(clean):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for other, (i, v) in enumerate(clean) if other != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "ties", "sparse", "negative"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(260, 12))
    if kind == "ties":
        x = np.round(rng.normal(size=(260, 12)) * 0.7) / 2
        x[20:120] = x[0]
    if kind == "sparse":
        x[rng.random(x.shape) < 0.8] = 0
        x[50] = 0
    if kind == "negative":
        x = -np.abs(x)
        x[100] = np.abs(x[100])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(300, None), (350, [float("nan")] * 12), (301, [1.0, None] + [0.0] * 10), (302, [float("inf")] + [0.0] * 11), (303, [1.0, 2.0]), (304, []), (None, [1.0] * 12), (7, rows[7][1]), (50, rows[50][1]), (50, rows[50][1]), (100, [3.0] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert sorted(tuple(r) for r in M.top_k(df).collect()) == brute(rows)
    assert sorted(tuple(r) for r in M.top_k(df, shard_rows=15, block_values=36, growth=3).collect()) == brute(rows)


def test_rows_that_share_a_query_id_are_candidates(spark):
    df = spark.createDataFrame([(50, [1.0]), (50, [3.0]), (7, [2.0])], "vec_id long, embedding array<double>")
    unit = 256 * 256
    assert sorted(tuple(r) for r in M.top_k(df).collect()) == [(50, 1, 7, 6 * unit), (50, 1, 50, 3 * unit), (50, 2, 7, 2 * unit), (50, 2, 50, 3 * unit)]


def test_threshold_rises_from_shard_to_shard():
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(size=(500, 8))).astype(np.int64)
    ids, q = np.arange(500), v[3]
    want = sorted((-int(x), int(i)) for i, x in zip(ids, v @ q, strict=True) if i != 3)[:5]
    best = []
    for part in np.split(ids, 5):
        best = M.Shard(part, v[part], np.ones(100, np.int64)).best(3, q, 5, best)
    assert best == want
    late = M.Shard(ids, v, np.ones(500, np.int64)).best(3, q, 5, [], threshold=-want[2][0])
    assert late[:3] == want[:3]


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert M.top_k(spark.createDataFrame([], schema)).count() == 0
    assert M.top_k(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in M.top_k(spark.createDataFrame([(0, [1.0]), (3, [2.0])], schema)).collect()] == [(0, 1, 3, 256 * 512)]
    big = M.top_k(spark.createDataFrame([(0, [1e30]), (3, [1e30]), (4, [-1e30])], schema)).orderBy("rank").collect()
    assert [r["vec_id"] for r in big] == [3, 4]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header class="site">Site name</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>First&nbsp; para
graph.<br><p>Second<p>Third &lt;b&gt; &#233;</p><aside>Aside</aside><div class="comments"><p>Reader says</p></div><form><p>Mail</p><button>Send</button></form></article>
<div id="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>"""


def test_article():
    assert H.main_text(PAGE) == "Head & line\nFirst para graph.\nSecond\nThird <b> é"
    assert H.main_text(PAGE[: PAGE.index("Second") + 6]) == "Head & line\nFirst para graph.\nSecond"
    for empty in (None, "", "<", "<<p", "</p></div>", "<script>x", "<!-- x", "<p class=\"x>y"):
        assert isinstance(H.main_text(empty), str)
    assert H.main_text("<p>a</p><div hidden>b</div><div style='display: none'>c</div>d <i>e</i>f") == "a\nd ef"
    assert H.main_text("<article class='comment'><p>x</p></article><main><p>y</p></main>") == "y"


def pages(n=12, host="h.org"):
    body = lambda i: f"<div class='top'>Always the same line</div><div class='body{i}'><p>Text number {i} about {i * 37 % 101}</p></div><div class='end'>Same end</div>"
    return [(i, f"https://{host}/{i}?q", f"<html><body>{body(i)}</body></html>") for i in range(n)]


def test_style_tree(spark):
    rows = pages() + pages(2, "few.org") + [(50, None, None), (51, "https://h.org/", ""), (0, "https://h.org/0?q", pages()[0][2])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["url"], r["text"]) for r in H.extract(df).collect()]
    assert len(got) == len(rows)
    texts = {(i, u): t for i, u, t in got}
    assert texts[3, "https://h.org/3?q"] == "Text number 3 about 10"
    assert texts[1, "https://few.org/1?q"].startswith("Always the same line\n")
    assert texts[50, None] == "" and texts[51, "https://h.org/"] == ""
    assert H.extract(df.limit(0)).count() == 0


def test_what_elements_say():
    keeps = {
        "<body class='no-sidebar header-fixed'><article><p>b</p></article>": "b",
        "<div class='has-sidebar'><article><p>b</p></article></div>": "b",
        "<div class='widget'><article><p>b</p></article></div><p>z</p>": "b",
        "<article><h2 id='related-work'>Related</h2><p>b</p><section id='social-impact'><p>c</p></section></article>": "Related\nb\nc",
        "<article><svg class='i'/><p>b</p></article>": "b",
        "<article><svg><text>no</text></svg><p>b</p><select><option>no</select><iframe src=x /><p>c</p></article>": "b\nc",
        "<article><p>b</p><section class='comments-area'><article><p>c</p></article></section></article>": "b",
        "<div class='comments'><article>c</article></div><div><p>main</p></div>": "main",
        "<article><p>b</p><div id='cookie-notice'>c</div><div class='site-footer'>d</div></article>": "b",
        "<div role='main'><p>b</p></div><p>z</p>": "b",
        "<div role='navigation'><p>n</p></div><div data-id='nav'><p>b</p></div>": "b",
        "<article><p>b</p><button>send</article>": "b\nsend",
        "<nav>a</nav><article></article><footer>c</footer>": "",
    }
    for page, text in keeps.items():
        assert H.main_text(page) == text, page


def test_deep_pages(spark):
    deep = "<div>" * 100_000
    assert H.main_text(deep + "text") == "text"
    assert H.main_text("".join(f"<div>t{i}" for i in range(20_000))).count("\n") == 19_999
    df = spark.createDataFrame([(i, "http://d.org/", x) for i, x in enumerate([deep + "text", "<p>" + "long words " * 300_000, "<b>" * 50_000 + "x", *["<div>" * 1500 + "y"] * 6])], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    assert got[0] == "text" and len(got[1]) == 300_000 * 11 - 1 and got[2] == "x"


class Plain:
    """A second reading: an XML tree of each page, entropies straight from their definitions, importance by recursion."""

    def __init__(self, rows):
        self.shown, self.texts, self.pages = {}, {}, {}
        self.trees = [(i, u, ElementTree.fromstring(h)) for i, u, h in rows]
        for i, (_, url, tree) in enumerate(self.trees):
            for path, e in self.walk(tree, ()):
                at = (self.host(url), path)
                self.pages.setdefault(at, set()).add(i)
                self.shown.setdefault(at, {}).setdefault(tuple(k for k, _ in groupby(c.tag for c in e)), set()).add(i)
                for text in self.own(e):
                    self.texts.setdefault(at, {}).setdefault(text, set()).add(i)

    @staticmethod
    def host(url):
        return url.split("/")[2].lower()

    @staticmethod
    def own(e):
        return [" ".join(t.split()) for t in [e.text, *[c.tail for c in e]] if t and t.strip()]

    @staticmethod
    def label(e):
        return (e.tag, re.sub(r"\d+", "0", e.get("class", "")))

    def walk(self, e, above):
        path = (*above, self.label(e))
        yield path, e
        for c in e:
            yield from self.walk(c, path)

    def importance(self, host, e, path):
        held = [UNKNOWN if (content := self.content(host, path)) is None else content for _ in self.own(e)]
        held += [self.importance(host, c, (*path, self.label(c))) for c in e]
        mean = sum(held) / len(held) if held else None
        m = len(self.pages[host, path])
        if m < 5:
            return UNKNOWN if mean is None else mean
        styles = [len(x) for x in self.shown[host, path].values()]
        presentation = sum(n / m * math.log(m / n) for n in styles) / math.log(m)
        part = 0.9 ** len(styles)
        return (1 - part) * presentation + part * (1.0 if mean is None else mean)

    def content(self, host, path):
        m = len(self.pages[host, path])
        found = [len(x) for x in self.texts.get((host, path), {}).values()]
        return 1 - sum(map(math.log, found)) / len(found) / math.log(m) if found and m >= 5 else None

    def low(self, host, e, path, prior):
        prior = min(prior, {"widget": 0.25, "ad": 0.0}.get(e.get("class"), 1.0))
        return prior * self.importance(host, e, path) < 0.2 and all(self.low(host, c, (*path, self.label(c)), prior) for c in e)

    def text(self, host, e, path, prior=1.0):
        """Blocks in page order: an element's text, its children, and what follows each of them."""
        gone = self.low(host, e, path, prior) or e.get("class") == "ad"
        prior = min(prior, {"widget": 0.25, "ad": 0.0}.get(e.get("class"), 1.0))
        out = []
        for place, t in enumerate([e.text, *[c.tail for c in e]]):
            if t and t.strip() and not gone and prior > 0:
                out.append(" ".join(t.split()))
            if place < len(e):
                c = e[place]
                out += self.text(host, c, (*path, self.label(c)), prior) if prior > 0 else []
        return out


UNKNOWN = H.UNKNOWN


def test_tree_and_texts_equal_a_plain_reading(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(rng.choice(["stone", "river", "letter", "window"], n)) + f" {rng.integers(1000)}"
    rows = []
    for i in range(90):
        host = ["a.org", "b.org", "c.org"][min(2, i % 7 // 3)] if i < 87 else "few.org"
        parts = ["<div class='top'>Welcome to the site</div>", f"<div class='menu{i % 3}x'><ul>" + "<li>same</li>" * int(rng.integers(1, 4)) + "</ul></div>"]
        parts += [f"<div class='widget'><p>{word(3) if i % 2 else 'about us'}</p></div>", f"<div class='ad'>{word(2)}</div>"]
        parts += [f"<section class='s{k}'><h2>{word(2)}</h2>tail {word(1)}<p>{word(6)}</p>{'<p>the same closing words</p>' if k else ''} end</section>" for k in range(int(rng.integers(1, 4)))]
        rng.shuffle(parts)
        rows.append((i, f"http://{host}/{i}", "<html><body>" + "".join(parts) + "<div class='end'>Same end</div></body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    plain = Plain(rows)
    found = H.parsed(df, ("page_id",))
    told = {(r["host"], r["path"]): r for r in H.style_tree(found).collect()}
    wanted = {(host, H.path_of(*[".".join(x for x in label if x) for label in path])): (host, path) for host, path in plain.pages if len(plain.pages[host, path]) >= 5}
    assert set(told) == set(wanted)
    for key, (host, path) in wanted.items():
        content = plain.content(host, path)
        assert told[key]["pages"] == len(plain.pages[host, path]) and told[key]["styles"] == len(plain.shown[host, path])
        assert (told[key]["content"] is None) == (content is None) and abs((told[key]["content"] or 0) - (content or 0)) < 1e-9
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    kept = 0
    for i, url, tree in plain.trees:
        host = plain.host(url)
        want = plain.text(host, tree, (plain.label(tree),))
        assert got[i].split("\n") == want, i
        kept += len(want)
    assert all("Welcome to the site" not in got[i] for i in range(80)) and "Welcome to the site" in got[88] and kept > 200


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables aren't here")
def test_query_equals_the_article_read_plainly(spark):
    from scriptorium.llm.queries import op8_html_text

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = op8_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.sub("</?b>", "", re.search("<article>(.*?)</article>", pages[r["page_id"]], re.S)[1])
        lines = [" ".join(references.unescape(x).split()) for x in re.split("<[^>]*>", inside)]
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


def test_shared_article_text_stays(spark):
    df = spark.createDataFrame([(i, f"http://c.org/{i}", PAGE) for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in H.extract(df).collect()} == {H.main_text(PAGE)}


def test_pages_that_mark_their_article_pass_through_the_tree_too(spark, monkeypatch):
    rows = [(i, f"http://c.org/{i}", PAGE.replace("<article", f"<p>{i}</p><article")) for i in range(20)] + pages(8)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = H.parsed(df, ("page_id",))
    assert found.where("size(__node_path) > 0 and size(__node_path) = size(__node_prior)").count() == len(rows)
    made, style_tree = [], H.style_tree
    monkeypatch.setattr(H, "style_tree", lambda found: made.append(style_tree(found)) or made[-1])
    texts = [{r["page_id"]: r["text"] for r in H.extract(df, few=few).where("url like '%c.org%'").collect()} for few in (H.FEW_NODES, 0)]
    assert texts[0] == texts[1] == {i: H.main_text(PAGE) for i in range(20)}
    assert all({r["host"] for r in tree.select("host").distinct().collect()} == {"c.org", "h.org"} for tree in made)
    both = [sorted(tuple(r) for r in H.extract(df, few=few).collect()) for few in (H.FEW_NODES, 0)]
    assert both[0] == both[1]
