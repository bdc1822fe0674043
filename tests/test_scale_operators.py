"""Operators that hold whatever a key, a chain or a list of parts grows to."""

import random
from collections import defaultdict
from itertools import combinations
from math import sqrt

import numpy as np
import pytest

from scriptorium.operators import cluster, frames, graph, sets, tiles
from scriptorium.operators.scans import numbered_by
from scriptorium.operators.scratch import Scope, staged


def union_find(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("few", [1 << 18, 40, 0])
def test_components_by_contraction(spark, few):
    rng = random.Random(few)
    edges = [(i, i + 1) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(230)] + [(2000, 2000 + i) for i in range(150)] + [(3000, 3000), (5, 5)]
    rng.shuffle(edges)
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long").repartition(6), few_edges=few).collect()}
    assert found == union_find(edges)
    named = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in edges], "src string, dst string").repartition(5)
    found = {r["node"]: r["component"] for r in graph.components(named, few_edges=few).collect()}
    assert found == union_find([(f"n{a}", f"n{b}") for a, b in edges])


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert [tuple(r) for r in graph.components(spark.createDataFrame([(4, 4)], "src long, dst long")).collect()] == [(4, 4)]


def test_closure_of_a_long_chain(spark):
    n = 600
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(n)], "parent string, child string")
    found = graph.ancestors(edges)
    assert found.count() == n * (n + 1) // 2
    assert found.agg({"distance": "max"}).first()[0] == n
    tree = graph.tree(edges, root="n0")
    assert {(r["node"], r["parent"], r["depth"]) for r in tree.collect()} == {("n0", None, 0)} | {(f"n{i}", f"n{i - 1}", i) for i in range(1, n + 1)}


def test_closure_of_random_graphs(spark):
    rng = random.Random(4)
    for _ in range(3):
        pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(40)}
        want = {}
        for start in range(25):
            level, depth, seen = {start}, 0, {start}
            while level:
                depth += 1
                level = {p for p, c in pairs for x in level if c == x} - seen
                seen |= level
                want |= {(start, x): depth for x in level}
        found = graph.ancestors(spark.createDataFrame([(f"{a}", f"{b}") for a, b in pairs], "parent string, child string"))
        assert {(int(r["node"]), int(r["ancestor"])): r["distance"] for r in found.collect()} == want


def sites(seed, n=60, items=40):
    rng = random.Random(seed)
    held = {f"s{i}": {f"i{k}" for k in range(items) if rng.random() < 0.15} | {"common"} for i in range(n)}
    return held | {"alone": {"own"}, "second": {"common"}}


@pytest.mark.parametrize("tile", [1, 7, 1024])
def test_overlaps_by_tiles(spark, tile):
    held = sites(tile)
    df = spark.createDataFrame([(s, i, "x") for s, own in held.items() for i in own], "site string, item string, other string")
    want = {(a, b): (len(held[a] & held[b]), len(held[a]), len(held[b])) for a, b in combinations(sorted(held), 2) if held[a] & held[b]}
    found = {(r["a"], r["b"]): (r["both"], r["size_a"], r["size_b"]) for r in sets.overlaps(df, "site", ["item"], tile=tile).collect()}
    assert found == want
    assert tiles.co_occurrences(df.limit(0), "site", ["item"]).count() == 0


def test_a_common_item_costs_a_tile(spark):
    """What meets is a row for each pair of tiles of an item, not of sites."""
    df = spark.range(2000).selectExpr("id as site", "'common' as item")
    assert tiles.co_occurrences(df, "site", ["item"]).count() == 2000 * 1999 // 2


def test_means_over_all_other_sites(spark):
    held = sites(3)
    df = spark.createDataFrame([(s, i) for s, own in held.items() for i in own], "site string, item string")
    n = len(held)
    for r in sets.imitation_innovation(df, "site", ["item"]).collect():
        own = held[r["site"]]
        similar = 1 + sum(len(own & x) / sqrt(len(own) * len(x)) for s, x in held.items() if s != r["site"])
        lacks = sum(len(own - x) for s, x in held.items() if s != r["site"])
        assert r["imitation_raw"] == pytest.approx(similar / n, abs=1e-12)
        assert r["innovation_raw"] == pytest.approx(lacks / (n - 1), abs=1e-12)


def test_many_parts_in_one_pass(spark):
    rng = random.Random(9)
    letters = "abcdefghij"
    parts = ["".join(rng.choices(letters, k=rng.randint(7, 12))) for _ in range(60_000)]
    texts = ["".join(rng.choices(letters, k=300)) for _ in range(40)] + [f"{'z' * i}{parts[i]}{'z' * i}" for i in range(40)] + ["zzz", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    told = spark.createDataFrame([(p,) for p in parts], "p string")
    known = set(parts)
    want = [i for i, t in enumerate(texts) if t and any(t[a : a + k] in known for k in range(7, 13) for a in range(len(t)))]
    one = frames.contains_any_semi(df, "t", told, "p")
    assert sorted(r["i"] for r in one.collect()) == want
    assert "Generate" not in one._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["i"] for r in frames.contains_any_semi(df, "t", told, "p", automaton_chars=200_000).collect()) == want


def test_places_in_an_order(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(9), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(5)
    assert [(r["a"], r["b"], r["number"]) for r in sorted(numbered_by(df, "a", "b").collect())] == [(a, b, n) for n, (a, b) in enumerate(sorted(rows))]
    assert numbered_by(df.limit(0), "a", "b").count() == 0


def test_scopes_own_their_tables(spark):
    from threading import Thread

    df, found = spark.range(5), {}

    def work(name):
        with Scope(spark) as own:
            found[name] = staged(df, name), own

    threads = [Thread(target=work, args=(n,)) for n in ("one", "two")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    with Scope(spark) as outer:
        kept = staged(df, "outer")
        with Scope(spark) as inner:
            gone = staged(df, "inner")
        inner.release()
    found["one"][1].release()
    assert kept.count() == found["two"][0].count() == 5
    for table in (gone, found["one"][0]):
        with pytest.raises(Exception, match="(?i)not.*exist"):
            table.count()
    outer.release()


def test_pairs_of_many_tiles_are_not_shuffled(spark):
    """Dense items are multiplied, rare ones added by place; a pair of tiles is added up whole, so pairs meet no exchange of their own."""
    rng = random.Random(5)
    held = {i: {k for k in range(130) if rng.random() < (0.9 if k < 120 else 0.03)} | {"all"} for i in range(800)}
    df = spark.createDataFrame([(i, f"i{k}") for i, own in held.items() for k in own], "site long, item string")
    pairs = sets.overlaps(df, "site", ["item"], tile=70)  # 78 pairs of tiles
    assert "hashpartitioning(x" not in pairs._jdf.queryExecution().executedPlan().toString()
    found = {(r["a"], r["b"]): r["both"] for r in pairs.collect()}
    assert found == {(a, b): len(held[a] & held[b]) for a, b in combinations(range(800), 2)}


def test_trees_of_a_large_partition_come_in_parts(spark):
    """A task that may hold few nodes passes trees on in parts; components are the same."""
    rng = random.Random(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        edges = spark.createDataFrame([(rng.randrange(400), rng.randrange(400)) for _ in range(300)], "a long, b long").coalesce(1)
        parts, whole = graph.forests(edges, 16).collect(), graph.forests(edges, None).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(parts) > len(whole)
    ends = [{tuple(r) for r in graph.components(spark.createDataFrame(rows, "src long, dst long")).collect()} for rows in (parts, whole)]
    assert ends[0] == ends[1]


def test_marc_values_are_made_once(spark, tmp_path):
    """No filter on the size of the map is inferred, which would make it again; repeated keys are joined in order."""
    from scriptorium.plans import catalogue
    from scriptorium.sources.readers import marc_values

    spark.createDataFrame([(1, 2, 3, 1)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    told = catalogue.marc_flattened(spark, str(tmp_path))
    assert told._jdf.queryExecution().optimizedPlan().toString().count("map_from_arrays") == 1
    assert sorted(map(tuple, told.collect())) == [(11, "001", "c2"), (11, "016_a", "z3 | y"), (11, "245_a", "Title 2")]
    schema = "record long, controlfields array<struct<_tag:string,_VALUE:string>>, datafields array<struct<_tag:string,`marc:subfield`:array<struct<_code:string,_VALUE:string>>>>"
    rows = [(1, [("001", "a"), ("001", "b"), ("002", None)], [("016", [("a", "x"), ("a", "")]), ("016", None)]), (2, None, None)]
    values = {r["record"]: r["values"] for r in marc_values(spark.createDataFrame(rows, schema)).collect()}
    assert values == {1: {"001": "a | b", "016_a": "x"}, 2: {}}


def test_checked_links_meet_by_title_and_body(spark):
    """Against all pairs: repeated ids, journals with several titles and bodies, titles that one journal has."""
    from scriptorium.operators import panels

    rng = random.Random(3)
    rows = [(rng.randrange(25), rng.choice(["A", "B", "C", f"own {i}"]), f"/ {rng.choice('ABC')}; own {rng.randrange(60)}" if i % 2 else None, "; ".join(rng.sample(["x", "y", "z"], rng.randrange(3)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, title string, related string, body string")
    told = panels.title_links_checked(df, "id", "title", "related", "body")
    found = [tuple(r) for r in told.collect()]
    held = [(i, t.lower(), {b for b in body.split("; ") if b}) for i, t, _, body in rows]
    want = set()
    for src, _, related, _ in rows:
        for t in (x.strip().lower() for x in (related or "/ ")[1:].split(";")):
            named = [x for x in held if x[1] == t]
            mine = set().union(*[b for i, _, b in held if i == src])
            want |= {(src, i) for i, _, b in named if i != src and (len(named) == 1 or b & mine)}
    assert len(found) == len(set(found)) and set(found) == want
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" not in plan  # pairs of a title that share no body are never made


def test_components_go_round_the_driver(spark):
    """Tables of nodes are merged, whatever size their files have."""
    from scriptorium.operators import panels

    links = spark.range(200).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst")
    journals = spark.range(300).selectExpr("cast(id as string) as id", "'t' as title")
    told = panels.families(journals, links, "id", "title")
    told.collect()
    assert "BroadcastHashJoin" not in told._jdf.queryExecution().executedPlan().toString()


def test_taxonomy_closure_makes_numbers_distinct_first(spark, tmp_path):
    """Before names are joined to lines, sites and suppliers are distinct numbers in a written table."""
    from scriptorium.operators import frames
    from scriptorium.plans import catalogue

    written, cut = [], frames.cut
    frames.cut = lambda df: written.append(df.columns) or cut(df)
    try:
        catalogue.taxonomy_closure(spark, "/root/testdata/sf0.001")
    finally:
        frames.cut = cut
    assert ["sitedomain", "l_suppkey"] in written


def plain_ward(points):
    """Merges (squared height, i, j) by looking through all pairs each time; of equal ones the first."""
    d = ((points[:, None] - points[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    size, alive, merges = np.ones(len(points)), set(range(len(points))), []
    while len(alive) > 1:
        height, i, j = min((d[i, j], i, j) for i, j in combinations(sorted(alive), 2))
        merges.append((height, i, j))
        alive.remove(j)
        for x in alive - {i}:
            d[i, x] = d[x, i] = ((size[i] + size[x]) * d[i, x] + (size[j] + size[x]) * d[j, x] - size[x] * height) / (size[i] + size[j] + size[x])
        size[i] += size[j]
    return merges


def test_ward_of_points_with_ties():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        for points in (rng.normal(size=(n, 3)), rng.integers(0, 3, size=(n, 2)).astype(float)):
            found, want = cluster.merged(cluster.distances(points), np.ones(n)), plain_ward(points)
            assert [m[0] for m in found] == pytest.approx([m[0] for m in want], abs=1e-9)
            if len({tuple(p) for p in points}) == n and points.shape[1] == 3:
                assert [m[1:] for m in found] == [m[1:] for m in want]


@pytest.mark.parametrize("few", [1000, 20, 5, 1])
def test_ward_of_more_sites_than_one_task_takes(spark, few):
    rng = random.Random(11)
    sites = {f"s{i:03}": {rng.randrange(40) for _ in range(rng.randrange(5, 20))} for i in range(90)}
    for i in range(0, 60, 4):
        sites[f"s{i:03}"] = sites[f"s{i % 8 + 70:03}"]  # copies
    own = spark.createDataFrame([(s, x) for s, items in sites.items() for x in items], "site string, i int").repartition(5)
    same = sets.same_sets(own, "site", ["i"])
    names = sorted(sites)
    first = {}
    assert {r["site"]: r["first"] for r in same.collect()} == {s: first.setdefault(frozenset(sites[s]), s) for s in names}
    points = np.array([[len(sites[a] & sites[b]) / len(sites[a] | sites[b]) for b in names] for a in names])
    tree = cluster.in_order(plain_ward(points), len(names))
    want = [(names[x], int(c)) for x, c in enumerate(cluster.flat(tree, len(names), 6))]
    at = {names[x]: p for p, x in enumerate(cluster.leaves(tree, len(names)))}
    firsts = own.join(same.where("site = first").select("site"), "site", "left_semi")
    for pairs, copies in ((own, None), (firsts, same)):
        found = cluster.ward_clusters(own, sets.jaccard(sets.overlaps(pairs, "site", ["i"])), "site", "jaccard", 6, same=copies, few=few, tile=16, chunk=7).collect()
        told = {r["site"]: r["cluster"] for r in found}
        assert len(found) == len(names) and sorted(r["position"] for r in found) == list(range(len(names)))
        assert len({(told[s], c) for s, c in want}) == 6  # without `same` rounding decides which of equal sites is left
        if copies is not None:
            assert sorted(told.items()) == want and {r["site"]: r["position"] for r in found} == at


@pytest.mark.parametrize("few, block, sent", [(20, 16, 1 << 20), (5, 4096, 1 << 20), (1, 7, 1 << 20), (20, 16, 0)])
def test_ward_from_sets_writes_no_matrix(spark, few, block, sent, monkeypatch):
    """Of more distinct sites than one task takes, the tree is that of all pairs, without a row for a pair of sites or a table of products."""
    monkeypatch.setattr(cluster, "SENT", sent)
    rng = random.Random(13)
    sites = {f"s{i:03}": {rng.randrange(i // 60 * 30, i // 60 * 30 + 40) for _ in range(rng.randrange(5, 20))} for i in range(120)}  # two halves that share little
    for i in range(0, 60, 4):
        sites[f"s{i:03}"] = sites[f"s{i % 8 + 70:03}"]  # copies
    own = spark.createDataFrame([(s, x) for s, items in sites.items() for x in items], "site string, i int").repartition(5)
    same = sets.same_sets(own, "site", ["i"])
    names = sorted(sites)
    points = np.array([[len(sites[a] & sites[b]) / len(sites[a] | sites[b]) for b in names] for a in names])
    tree = cluster.in_order(plain_ward(points), len(names))
    at = {names[x]: p for p, x in enumerate(cluster.leaves(tree, len(names)))}
    firsts = own.join(same.where("site = first").select("site"), "site", "left_semi")
    asked = []
    pairs = lambda: asked.append(1) or sets.jaccard(sets.overlaps(firsts, "site", ["i"]))
    found = cluster.ward_clusters(own, pairs, "site", "jaccard", 6, same=same, few=few, tile=16, chunk=7, items=firsts, block=block).collect()
    assert sorted((r["site"], r["cluster"]) for r in found) == [(names[x], int(c)) for x, c in enumerate(cluster.flat(tree, len(names), 6))]
    assert {r["site"]: r["position"] for r in found} == at
    assert len(asked) == (sent == 0)


@pytest.mark.parametrize("few", [sets.FEW_WORDS, 0])
def test_shared_words_without_a_shuffle_of_words(spark, few, monkeypatch):
    monkeypatch.setattr(sets, "PAIRS_AT_ONCE", 50)
    rng = random.Random(7)
    asked = [(f"q{i}", rng.sample([f"w{x}" for x in range(60)], rng.randrange(0, 25))) for i in range(23)] + [("none", None), ("empty", [])]
    held = [(i, rng.sample([f"w{x}" for x in range(90)], rng.randrange(0, 60))) for i in range(157)] + [(900, None), (901, [])]
    want = {(q, d, n) for q, a in asked for d, b in held if (n := len(set(a or ()) & set(b or ()))) >= 5}
    frame = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(3)
    got = sets.share_words(frame(asked, "q string, words array<string>"), "q", frames.cut(frame(held, "d long, words array<string>")), "d", "words", 5, few=few)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 100
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert few == 0 or not any(x in plan for x in ("Exchange", "Generate", "Join"))
    nothing = sets.share_words(frame(asked, "q string, words array<string>").limit(0), "q", frame(held, "d long, words array<string>"), "d", "words", 5, few=few)
    assert nothing.count() == 0
