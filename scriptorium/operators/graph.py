"""Graphs as edge tables: breadth-first search, closure, components and trees, by joined rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut

#: So many edges, counted, are tied together in one task: the end of every contraction.
FEW_EDGES = 1 << 18
#: A task that makes trees holds so many nodes, then passes them on and begins anew.
MOST_NODES = 1 << 19


def bfs(edges: DataFrame, roots: DataFrame, most_depth: int = 2, seen: DataFrame | None = None) -> DataFrame:
    """(node, depth) of what is reachable from roots (node) along edges (src, dst) in at most most_depth steps.

    Nodes of `seen` (node, depth) count as visited, as after an earlier, shallower run.
    """
    found = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    if seen is not None:
        found = cut(found.join(seen, "node", "left_anti").unionByName(seen.select("node", F.col("depth").cast("int"))))
    frontier = found.where("depth = 0") if seen is None else found.where(F.col("depth") == (found.agg(F.max("depth")).first()[0] or 0))
    start = 0 if seen is None else (found.agg(F.max("depth")).first()[0] or 0)
    for depth in range(start + 1, most_depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    return found


def forests(edges: DataFrame, most_nodes: int | None = MOST_NODES) -> DataFrame:
    """Of each partition of edges (a, b) its trees, as rows (a, b): a node and the smallest of its tree.

    A task holds at most most_nodes nodes and those of one batch: then it passes on what it has and begins anew, so that trees of a large
    partition come in parts, which hold together by their nodes. With None a partition is tied together whole.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}
        kinds = None

        def told() -> Iterator[pa.RecordBatch]:
            nodes, roots = [], []
            for node in up:
                root = node
                while up[root] != root:
                    root = up[root]
                up[node] = root
                if root != node:
                    nodes.append(node)
                    roots.append(root)
                if len(nodes) == 1 << 16:
                    yield batch_of(nodes, roots)
                    nodes, roots = [], []
            if nodes:
                yield batch_of(nodes, roots)

        def batch_of(nodes: list, roots: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(nodes, kinds.field("a").type), pa.array(roots, kinds.field("b").type)], names=["a", "b"])

        for batch in batches:
            kinds = batch.schema
            for a, b in zip(*[batch.column(c).to_pylist() for c in ("a", "b")], strict=True):
                while (x := up.setdefault(a, a)) != a:
                    up[a] = a = up[x]  # halves the path on the way
                while (x := up.setdefault(b, b)) != b:
                    up[b] = b = up[x]
                if a < b:
                    up[b] = a
                elif b < a:
                    up[a] = b
            if most_nodes is not None and len(up) >= most_nodes:
                yield from told()
                up.clear()
        if up:
            yield from told()

    return edges.select("a", "b").mapInArrow(joined, edges.select("a", "b").schema)


def components(edges: DataFrame, few_edges: int = FEW_EDGES) -> DataFrame:
    """(node, component) for the nodes of undirected edges (src, dst); a component is its smallest node.

    Every partition is reduced to its forest before anything is shuffled. Then, in rounds, each node is contracted into the one of its neighbours and
    itself that comes first by a hash that changes with the round, which takes away a share of the nodes whatever the graph's shape; edges
    between what is left are made forests again. When few_edges are left, counted, one task ties them together. The rounds are
    gone back through then, each telling what its nodes were contracted into. Tables of nodes are written small, so Spark would broadcast them
    by way of the driver until they are large; they are asked to be merged.
    """
    own = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    loops = own.select("a").union(own.select("b")).distinct()
    now, rounds = cut(forests(own.where("a <> b"))), []
    while (left := now.count()) > few_edges:
        both = now.union(now.select("b", "a"))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(rounds))).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least("m", order("a"))["v"].alias("to"))
        rounds.append(cut(first))
        into = lambda c: rounds[-1].select(F.col("a").alias(f"__{c}"), F.col("to").alias(c))  # noqa: B023, E731
        ends = now.toDF("x", "y").join(into("a").hint("merge"), F.col("x") == F.col("__a")).join(into("b").hint("merge"), F.col("y") == F.col("__b")).where("a <> b").select("a", "b")
        now = cut(forests(ends.distinct()))
    tied = cut(forests(now.coalesce(1), None)) if left else now  # few edges, counted
    for told in reversed(rounds):
        named = tied.toDF("__node", "__root").hint("merge")
        tied = cut(told.join(named, told["to"] == named["__node"], "left").select("a", F.coalesce("__root", "to").alias("b")))
    if rounds:  # named by what was left, not by the smallest
        least = tied.groupBy("b").agg(F.min("a").alias("__least")).select(F.col("b").alias("__b"), F.least("b", "__least").alias("__least")).hint("merge")
        tied = tied.join(least, tied["b"] == least["__b"]).select("a", F.col("__least").alias("b"))
    return loops.join(tied.hint("merge"), "a", "left").select(F.col("a").alias("node"), F.coalesce("b", "a").alias("component"))


def ancestors(edges: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(node, ancestor, distance): the transitive closure of (parent, child), with the shortest distance; cycles end.

    Paths are doubled: what lies beyond twice 2**k steps is what lies beyond the nodes at 2**k, so rounds grow with the logarithm of the depth.
    With most_depth, raises if there are ancestors beyond.
    """
    found = cut(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node <> ancestor").distinct().withColumn("distance", F.lit(1)))
    reach = 1
    while True:
        ends = found.where(F.col("distance") == reach).select("node", F.col("ancestor").alias("__mid"))
        beyond = found.select(F.col("node").alias("__mid"), "ancestor", (F.col("distance") + reach).alias("distance"))
        step = ends.join(beyond, "__mid").where("node <> ancestor").groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        fresh = cut(step.join(found, ["node", "ancestor"], "left_anti").select("node", "ancestor", "distance"))
        if fresh.isEmpty():
            if most_depth is not None and not found.where(F.col("distance") > most_depth).isEmpty():
                raise RuntimeError(f"there are ancestors more than {most_depth} levels up")
            return found
        found = cut(found.unionByName(fresh))
        reach *= 2


def with_missing_ancestors(pairs: DataFrame, edges: DataFrame, key: str = "sitedomain") -> DataFrame:
    """Pairs (key, hypernym, hyponym) and the taxonomy edges (parent, child) above their ends that a key lacks."""
    above = ancestors(edges)
    ends = pairs.select(key, F.col("hypernym").alias("node")).union(pairs.select(key, F.col("hyponym").alias("node"))).distinct()
    nodes = ends.unionByName(ends.join(above, "node").select(key, F.col("ancestor").alias("node"))).distinct()
    own = nodes.join(edges.select(F.col("child").alias("node"), F.col("parent").alias("hypernym")).distinct(), "node")
    return pairs.select(key, "hypernym", "hyponym").union(own.select(key, "hypernym", F.col("node").alias("hyponym"))).distinct()


def tree(edges: DataFrame, root: str = "Homepage", most_depth: int | None = None) -> DataFrame:
    """(node, parent, depth) of the tree below root: each node once, under its smallest parent of least depth. With most_depth, raises if there are nodes beyond."""
    below = ancestors(edges).where(F.col("ancestor") == root).select("node", F.col("distance").alias("depth"))
    if most_depth is not None and not below.where(F.col("depth") > most_depth).isEmpty():
        raise RuntimeError(f"there are nodes more than {most_depth} levels down")
    placed = cut(edges.sparkSession.createDataFrame([(root, 0)], "node string, depth int").unionByName(below.select("node", F.col("depth").cast("int").alias("depth"))))
    above = placed.select(F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"))
    parents = edges.select("parent", F.col("child").alias("node")).join(above, "parent").join(placed, ["node", "depth"])
    least = parents.groupBy("node", "depth").agg(F.min("parent").alias("parent"))
    return placed.join(least, ["node", "depth"], "left").select("node", "parent", "depth")


def roots(edges: DataFrame) -> DataFrame:
    """(node): parents that are nobody's child."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")
