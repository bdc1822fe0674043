import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import cluster, frames, graph, panels, rates, resolve, sets, survival


def rows(df, *order):
    return sorted(tuple(r) for r in (df.select(*order) if order else df).collect())


def test_components_match_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        top[max(ra, rb)] = min(ra, rb)
    got = dict(rows(graph.components(spark.createDataFrame(edges, "src int, dst int"))))
    assert got == {x: find(x) for x in list(top)}


def test_closure_and_tree(spark):
    edges = spark.createDataFrame([("Homepage", "a"), ("a", "b"), ("b", "c"), ("x", "c"), ("c", "b")], "parent string, child string")
    pairs = spark.createDataFrame([("s", "b", "c")], "sitedomain string, hypernym string, hyponym string")
    closed = graph.with_missing_ancestors(pairs, edges)
    assert {("s", "a", "b"), ("s", "Homepage", "a"), ("s", "x", "c")} <= set(rows(closed))
    again = graph.with_missing_ancestors(closed, edges)
    assert rows(again) == rows(closed)
    assert rows(graph.tree(edges)) == [("Homepage", None, 0), ("a", "Homepage", 1), ("b", "a", 2), ("c", "b", 3)]
    assert rows(graph.roots(edges)) == [("Homepage",), ("x",)]


def test_bfs_resumes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.bfs(edges, start, 2)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(graph.bfs(edges, start, 3, seen=graph.bfs(edges, start, 1))) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]


def test_frames(spark):
    df = spark.createDataFrame([(1, "x", None), (2, " ", "v")], "b int, a string, c string")
    assert frames.priority_first(df, ["c", "zz"]).columns == ["c", "a", "b"]
    assert frames.first_column(df, ["Q", "A"]) == "a"
    with pytest.raises(ValueError):
        frames.require_columns(df, ["nope"])
    pairs = spark.createDataFrame([("h", "/a"), ("h", "/ab"), ("h", "/a/b"), ("h", ""), ("g", "/a")], "g string, p string")
    assert rows(frames.prefix_pairs(pairs, "g", "p")) == [("h", "", "/a"), ("h", "", "/a/b"), ("h", "", "/ab"), ("h", "/a", "/a/b"), ("h", "/a", "/ab")]
    assert rows(frames.unit_histogram(spark.createDataFrame([(1.4,), (1.6,), (2.0,)], "x double"), "x")) == [(1, 1), (2, 2)]
    assert rows(frames.contains_any_semi(spark.createDataFrame([("http://A.org/",), ("b",)], "u string"), "u", spark.createDataFrame([("a.org",)], "d string"), "d")) == [("http://A.org/",)]


def test_survival_of_small_samples(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("a", 3, 1), ("b", 5, 0)], "g string, duration int, event int")
    curve = survival.km(df, ["g"])
    got = {r["t"]: r["s"] for r in curve.collect()}
    assert got[1] == 0.75 and got[3] == 0.0
    assert rows(survival.median_survival(curve, ["g"])) == [("a", 3)]
    assert rows(survival.rmst(curve, ["g"], 10)) == [("a", 1 + 0.75 * 2)]
    assert survival.rmst_of(np.array([1, 2, 3, 3]), np.array([1, 0, 1, 1]), 10) == 1 + 0.75 * 2
    assert rows(survival.survival_at(curve, ["g"], [0, 1, 2])) == [("a", 1.0, 0.75, 0.75)]
    assert rows(survival.censor_marks(df, curve, ["g"])) == [("a", 2, 0.75), ("b", 5, 1.0)]
    layered = survival.strata(spark.createDataFrame([(x,) for x in (1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9)], "y int"), "y")
    assert layered.agg(F.min("stratum"), F.max("stratum")).first()[0] == 1
    boot = survival.bootstrap_rmst(df, "g", "a", "b", 10, 50).first()
    assert boot["difference"] == 2.5 - 10 and boot["low"] <= boot["difference"] <= boot["high"]


def test_logrank_needs_both_groups(spark):
    df = spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 1, 1), ("b", 3, 1, 2)], "g string, duration int, event int, s int")
    row = survival.logrank(df, "g", "a", "b", "s").first()
    assert (row["o_minus_e"], row["v"], row["z"]) == (0.0, 0.0, None)


def test_rates_and_regression(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), ("y", 1)], "g string, f int")
    assert [(r["g"], r["k"], r["n"]) for r in rates.rates(df, "g", "f", ["x", "z"]).orderBy("g").collect()] == [("x", 1, 2), ("z", 0, 0)]
    text = spark.createDataFrame([("Developed regions",), ("developing",), (None,)], "c string")
    assert [r[0] for r in text.select(rates.development_class(F.col("c"))).collect()] == ["Developed", "Developing", "Unknown"]
    line = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "x double, y double")
    row = rates.regression(line, "y", "x").first()
    assert abs(row["slope"] - 2) < 1e-12 and abs(row["r2"] - 1) < 1e-12


def test_journals(spark):
    cols = "id string, title string, related string, body string, published string"
    df = spark.createDataFrame(
        [("1", "A", "/ B", "x", "1900-1910"), ("2", "B", "A / C", "x;y", "1911-1950"), ("3", "C", None, "z", "1951-"), ("4", "Same", None, "p", "1980"), ("5", "same", None, "q", None), ("6", "D", "Same /", "q", "2000-2001")], cols
    )
    tied = panels.lineages(df, "id", "title", "related", "published")
    got = {r["lineage"]: (r["members"], r["start_year"], r["end_year"], r["event"]) for r in tied.collect()}
    assert got["1"] == (["1", "2", "3"], 1900, 2025, 0)
    assert got["4"][0] == ["4", "5", "6"]
    checked = rows(panels.title_links_checked(df, "id", "title", "related", "body"))
    assert ("6", "5") in checked and ("6", "4") not in checked and ("1", "2") in checked
    family = panels.families(df, panels.title_links(df, "id", "title", "related"), "id", "title").orderBy(F.desc("size"), "component").first()
    assert (family["size"], family["ids"]) == (3, "1 | 2 | 3")
    panel = panels.year_panel(panels.panel_spans(df, "published", "id"), "id").where("year = 1911").first()
    assert (panel["active"], panel["births"], panel["deaths"]) == (1, 1, 0)


def test_candidates(spark):
    entities = spark.createDataFrame([("k", ["Academy of X"], "Peru"), ("m", ["Nothing"], None)], "key string, names array<string>, country string")
    found = spark.createDataFrame(
        [("k", "Q2", "Academy of X", "academy in Peru", ["AX"], 1), ("k", "Q1", "Academy of X", "academy in Peru", None, 0), ("k", "Q3", "Other", None, None, 2), ("m", "Q4", "Else", "x", None, 0)],
        "key string, id string, label string, description string, aliases array<string>, position int",
    )
    assert rows(resolve.best_candidates(entities, found, "key", "names", "country")) == [("k", "Q1", 120 + 12 + 4 + 25 + 8 + 1)]
    asked = resolve.search_queries(spark.createDataFrame([(1, "A", "A ", None, "P")], "i int, a string, b string, c string, p string"), "i", ["a", "b", "c"], "p")
    assert rows(asked, "query") == [("A",), ("A P",)]


def test_cross_walk(spark):
    walk = spark.createDataFrame([("Q1", "T", "http://d/T", True), ("Q2", "U", "http://d/U", False)], "qid string, title string, dbpedia_url string, dbpedia_exists boolean")
    df = spark.createDataFrame([(1, "Q1", None, None), (2, None, "U", None), (3, None, None, "http://d/T")], "i int, wikidata_id string, title string, dbpedia_url string")
    assert rows(resolve.cross_walk(df, walk)) == [(1, "Q1", "T", "http://d/T"), (2, "Q2", "U", None), (3, "Q1", "T", "http://d/T")]


def test_ward(spark):
    points = np.array([[0.0], [0.1], [5.0], [5.2], [20.0]])
    merges = cluster.ward(points)
    assert [m[:2] for m in merges[:2]] == [(0, 1), (2, 3)] and merges[-1][3] == 5
    assert abs(merges[0][2] - 0.1) < 1e-12
    assert len(set(cluster.flat(merges, 5, 3))) == 3
    sim = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "a string, b string, s double")
    sites = spark.createDataFrame([(x,) for x in "abcd"], "site string")
    got = {r["site"]: r["cluster"] for r in cluster.ward_clusters(sites, sim, "site", "s", 2).collect()}
    assert got["a"] == got["b"] != got["c"] == got["d"]


def test_similarity_is_symmetric_and_bounded(spark):
    own = spark.createDataFrame([("p", 1), ("p", 2), ("q", 2), ("q", 1), ("r", 2)], "site string, i int")
    pairs = sets.overlaps(own, "site", ["i"])
    assert {(r["a"], r["b"]): r["jaccard"] for r in sets.jaccard(pairs).collect()} == {("p", "q"): 1.0, ("p", "r"): 0.5, ("q", "r"): 0.5}


def test_shared_words_equal_all_pairs(spark):
    import numpy as np

    from scriptorium.operators import sets

    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(40)]
    asked = {i: sorted({"the", *rng.choice(vocabulary, 9)}) for i in range(20)}
    held = {i: sorted({"the", *rng.choice(vocabulary, int(rng.integers(1, 30)))}) for i in range(60)}
    got = sets.share_words(spark.createDataFrame(list(asked.items()), "q long, words array<string>"), "q", spark.createDataFrame(list(held.items()), "d long, words array<string>"), "d", "words", 5)
    want = {(q, d, n) for q, a in asked.items() for d, b in held.items() if (n := len(set(a) & set(b))) >= 5}
    assert {tuple(r) for r in got.collect()} == want and want


def test_components_of_a_chain_and_a_hub(spark):
    from scriptorium.operators import graph

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 500)] + [(5000, 5000)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(500)) and got[5000] == 5000


def test_bootstrap_areas_by_counts():
    import numpy as np

    from scriptorium.operators import survival

    rng = np.random.default_rng(2)
    t, e, m = rng.integers(1, 40, 30), rng.integers(0, 2, 30), rng.integers(0, 5, 30)
    assert abs(survival.rmst_of(t, e, 25, m) - survival.rmst_of(np.repeat(t, m), np.repeat(e, m), 25)) < 1e-9


def test_prefix_pairs_equal_all_pairs(spark):
    from scriptorium.operators import frames

    values = ["", "a", "ab", "abc", "b", "bc", "abcd", "x/y", "x/y/z"]
    df = spark.createDataFrame([(g, v) for g in "pq" for v in values if g == "p" or len(v) != 1], "g string, v string")
    rows = {tuple(r) for r in df.collect()}
    want = {(g, a, b) for g, a in rows for h, b in rows if g == h and a != b and b.startswith(a)}
    assert {tuple(r) for r in frames.prefix_pairs(df, "g", "v").collect()} == want


def test_contains_any_semi_beyond_the_bound(spark):
    texts = ["http://A.org/", "b", "", None, "x" * 1200 + "needle" + "y" * 700, "x" * 509 + "needle", "x" * 511 + "needl", "b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, u string")
    for found in (["a.org", "needle", "zz", "needle", None], ["", "q"], ["A.org", "q"], ["y" * 701, "/"]):
        parts = spark.createDataFrame([(p,) for p in found], "d string")
        want = [i for i, t in enumerate(texts) if t is not None and any(p is not None and p in t.lower() for p in found)]
        for most in (100, 1):
            assert sorted(r["i"] for r in frames.contains_any_semi(df, "u", parts, "d", automaton_chars=most).collect()) == want
