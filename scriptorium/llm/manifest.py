"""A Merkle manifest of a dataset: a tree for each value of a column, and one over their roots, by superblocks.

A row's leaf is the SHA-256 of its columns, each written with its length. Leaves are numbered in order within their tree, so a
leaf's index says where it stands at every level. Indices are bucketed by fanout ** levels: applyInPandas collapses that many
levels of a bucket at a time, which gives the bucket's root and, for every node, its siblings at those levels. The roots of
the buckets are the nodes of the next reduction, until each tree is one node. A leaf's proof is that of its bucket,
followed by the bucket's among the next buckets and so on, and by its tree's in the tree of trees.

No group has more than fanout ** levels rows, whatever a tree holds. Texts are hashed where they are read and
never shuffled; what is shuffled are digests. Indices come from ranges of the order and what earlier ranges hold.

Cases: a null column is written as "-"; null keys are a tree, the first one; null ids come first in their tree, equal ids in
the order of their leaves; repeated rows are leaves each; an empty text isn't a null one; a text of any length is hashed
whole; an empty table has no rows and no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import numbered_by
from .common import staged

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT, LEVELS = 2, 10
NODE = "tree long, index long, lefts array<string>, rights array<string>, up string"


def written(value: Column) -> Column:
    """A value with its length in bytes; "-" if it is null."""
    told = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[written(v) for v in values]).cast("binary"), 256)


def height(n: int, fanout: int) -> int:
    """Levels until n nodes are one."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * fanout
    return levels


def collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """NODE for each of nodes (tree, index, n, digest): the digests left and right of it, level by level in its bucket, and the bucket's root."""
    size = fanout**levels

    def collapsed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index")
        row = rows["digest"].tolist()
        left_at, right_at = [], []
        for _ in range(min(levels, height(int(rows["n"].iloc[0]), fanout))):
            runs = [row[i : i + fanout] for i in range(0, len(row), fanout)]
            left_at.append(["".join(run[:j]) for run in runs for j in range(len(run))])
            right_at.append(["".join(run[j + 1 :]) for run in runs for j in range(len(run))])
            row = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
        places = range(len(rows))
        along = lambda table: [[at[i // fanout**level] for level, at in enumerate(table)] for i in places]
        return pd.DataFrame({"tree": rows["tree"].to_numpy(), "index": rows["index"].to_numpy(), "lefts": along(left_at), "rights": along(right_at), "up": row[0]})

    return nodes.groupBy("tree", F.floor(F.col("index") / size).alias("bucket")).applyInPandas(collapsed, NODE)


def reduced(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """tree, index, lefts, rights and root of each of nodes (tree, index, n, digest); n is the number of nodes of its tree."""
    size, stages = fanout**levels, []
    while True:
        own = staged(collapse(nodes, fanout, levels), "nodes")
        more = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
        stages.append(own)
        if more <= size:
            break
        # Every bucket's first node brings its root up; a bucket's number is its index there.
        counts = nodes.where("index = 0").select(F.col("tree").alias("__tree"), F.ceil(F.col("n") / size).alias("n"))
        heads = own.where(F.col("index") % size == 0).select("tree", F.floor(F.col("index") / size).alias("index"), F.col("up").alias("digest"))
        nodes = staged(heads.join(counts, heads["tree"] == counts["__tree"]).select("tree", "index", "n", "digest"), "heads")
    above = None
    for own in reversed(stages):
        if above is None:
            above = own.select("tree", "index", "lefts", "rights", F.col("up").alias("root"))
            continue
        upper = above.select(F.col("tree").alias("__tree"), F.col("index").alias("__bucket"), F.col("lefts").alias("__lefts"), F.col("rights").alias("__rights"), "root")
        joined = own.join(upper, (own["tree"] == upper["__tree"]) & (F.floor(own["index"] / size) == upper["__bucket"]))
        above = joined.select("tree", "index", F.concat("lefts", "__lefts").alias("lefts"), F.concat("rights", "__rights").alias("rights"), "root")
    return above


def folded(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(F.arrays_zip(lefts.alias("a"), rights.alias("b")), leaf, lambda at, x: F.sha2(F.concat(x["a"], at, x["b"]).cast("binary"), 256))


def siblings(lefts: Column, rights: Column) -> Column:
    """A proof's digests, from leaf to root and left to right, put together."""
    return F.concat_ws("", F.zip_with(lefts, rights, lambda a, b: F.concat(a, b)))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "lang", order: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS, more: dict[str, Column] | None = None) -> DataFrame:
    """`order`, `key`, `more`, leaf, index, subroot, root, lefts and rights of each row; lefts and rights go up to the root.

    more: columns to carry, expressions over docs; written before anything is shuffled.
    """
    own = docs.select(F.col(order).alias("__order"), F.col(key).alias("__key"), leaf_of(*[F.col(c) for c in columns]).alias("leaf"), *[c.alias(f"__more_{n}") for n, c in (more or {}).items()])
    # The texts are read for this alone: ranges are drawn from what is written.
    leaves = numbered_by(staged(own, "leaves"), F.asc_nulls_first("__key"), F.asc_nulls_first("__order"), "leaf", name="__number")
    leaves = staged(leaves, "numbered")
    trees = leaves.groupBy("__key").agg(F.min("__number").alias("__first"), F.count("*").alias("__n"))
    trees = staged(numbered_by(trees, F.asc_nulls_first("__key"), name="__tree").withColumnRenamed("__key", "__k"), "trees")
    placed = leaves.join(trees, leaves["__key"].eqNullSafe(trees["__k"]))
    index = F.col("__number") - F.col("__first")
    nodes = placed.select(F.col("__tree").alias("tree"), index.alias("index"), F.col("__n").alias("n"), F.col("leaf").alias("digest"))
    lower = reduced(staged(nodes, "nodes"), fanout, levels)
    tops = lower.where("index = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.col("root").alias("digest"))
    tops = staged(tops, "subroots")
    upper = reduced(tops.withColumn("n", F.lit(tops.count())), fanout, levels)
    tree = upper.select(F.col("index").alias("__of"), F.col("lefts").alias("__lefts"), F.col("rights").alias("__rights"), F.col("root").alias("__root"))
    proofs = lower.join(tree, lower["tree"] == tree["__of"]).select("tree", "index", F.concat("lefts", "__lefts").alias("lefts"), F.concat("rights", "__rights").alias("rights"), F.col("root").alias("subroot"), F.col("__root").alias("root"))
    joined = placed.select(*leaves.columns, F.col("__tree").alias("tree"), index.alias("index")).join(proofs, ["tree", "index"])
    carried = [F.col(f"__more_{n}").alias(n) for n in (more or {})]
    return joined.select(F.col("__order").alias(order), F.col("__key").alias(key), *carried, "leaf", "index", "subroot", "root", "lefts", "rights")


def tampered(doc_id: Column) -> Column:
    """Rows on which verification is tried with a wrong leaf: 7 divides the CRC-32 of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def audited(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of docs with the root that each leaf and its siblings give, the leaf of a tampered row being that of n_chars + 1."""
    longer = F.col("n_chars").cast("decimal(20,0)") + 1
    wrong = leaf_of(*[longer if c == "n_chars" else F.col(c) for c in COLUMNS])
    tried = F.when(tampered(F.col("doc_id")) & F.col("n_chars").isNotNull(), wrong)
    found = manifest(docs, more={"__wrong": tried}, fanout=fanout, levels=levels)
    root = folded(F.coalesce("__wrong", "leaf"), F.col("lefts"), F.col("rights"))
    return found.withColumn("folded_root", root).withColumn("verified", F.col("folded_root") == F.col("root"))
