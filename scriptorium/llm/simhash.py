"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distances, components.

Two 64-bit fingerprints within k bits agree on at least BLOCKS - k of BLOCKS blocks. Every choice of
that many blocks is a key; distinct fingerprints meet under equal keys, and there each pair within k
bits is linked. Keys that more than COMPARED fingerprints have are counted first; theirs meet by finer keys, which
add as many blocks of the bits that the key leaves free, so that a group has at most 2**18 members whatever the
table. A task walks the rows of a key range in order. It keeps a forest of the links it has
verified instead of all pairs, which leaves components unchanged. Exact copies meet only once, as one
fingerprint. Components come from rounds of large-star and small-star steps, staged in the shared folder.

Cases: a null text and one without words have fingerprint zero and are linked like any other; a text of
one or two words has one shingle. Rows that repeat a doc_id keep a row each. A null doc_id gets a
component only through other members. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

SHINGLE, SEED, BITS, MOST_APART = 3, 42, 64, 3
BLOCKS = 6
#: Groups above this many distinct fingerprints are split by finer keys; what then still has more looks up its neighbours instead of comparing pairs.
COMPARED = 1 << 15
#: Rows of links that a task holds at a time.
HELD = 1 << 18


def signed(n: int) -> int:
    """The low 64 bits of n as a signed integer."""
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def choices(bits: list[int], blocks: int, apart: int) -> list[int]:
    """A mask for each choice of blocks - apart of the blocks that the bits are cut into."""
    edges = [round(len(bits) * i / blocks) for i in range(blocks + 1)]
    each = [sum(1 << b for b in bits[edges[i] : edges[i + 1]]) for i in range(blocks)]
    return [sum(c) for c in combinations(each, blocks - apart)]


def masks(blocks: int = BLOCKS, apart: int = MOST_APART) -> list[int]:
    """The masks of the keys, as signed 64-bit integers."""
    return [signed(m) for m in choices(list(range(BITS)), blocks, apart)]


def finer_masks(mask: int, blocks: int = BLOCKS, apart: int = MOST_APART) -> list[int]:
    """Masks that hold `mask` and some blocks of its free bits: two fingerprints that agree on `mask` and are close agree on one of them."""
    return [signed(mask | m) for m in choices([b for b in range(BITS) if not mask >> b & 1], blocks, apart)]


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; none without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    shingles = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, seed) for x in shingles), "<u8")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text, unsigned."""
    return fingerprint_of(shingle_hashes(text, shingle, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, unsigned; zero for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = np.array([fingerprint(x) for x in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest that it is connected with by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def nearby(x: np.ndarray, apart: int = MOST_APART) -> np.ndarray:
    """For each of the sorted distinct fingerprints x, the index of the smallest that it is connected with."""
    n = len(x)
    if n <= 64:
        a, b = np.triu_indices(n, 1)
        near = np.bitwise_count(x[a] ^ x[b]) <= apart
        return settle(n, a[near], b[near])
    label = np.arange(n)

    def unite(found: np.ndarray) -> None:
        old = np.unique(label[found])
        if len(old) > 1:
            label[np.isin(label, old)] = old[0]

    if n <= COMPARED:
        for i in range(n):
            unite(np.flatnonzero(np.bitwise_count(x ^ x[i]) <= apart))
        return label
    free = [np.uint64(1) << np.uint64(k) for k in range(BITS) if len(np.unique((x >> np.uint64(k)) & np.uint64(1))) > 1]
    flips = [np.bitwise_or.reduce(c) for w in range(1, apart + 1) for c in combinations(free, w)]
    a, b = [], []
    parents = label
    for k, flip in enumerate(flips):
        at = np.minimum(np.searchsorted(x, x ^ flip), n - 1)
        found = np.flatnonzero((x[at] == x ^ flip) & (at > np.arange(n)))
        a.append(found)
        b.append(at[found])
        if k % 32 == 31 or k == len(flips) - 1:
            p, q = np.concatenate(a), np.concatenate(b)
            parents = settle(n, np.concatenate([np.arange(n), p]), np.concatenate([parents, q]))
            a, b = [], []
    return parents


def links(keyed: DataFrame) -> DataFrame:
    """From rows (c, k, fp), sorted by (c, k, fp) within a partition: a forest (a, b), a > b, of the near pairs that share (c, k)."""

    def forest(c: np.ndarray, k: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (k[1:] != k[:-1])])
        ends = np.r_[starts[1:], len(x)]
        size = ends - starts
        a, b = [], []
        twos = starts[size == 2]
        near = twos[np.bitwise_count(x[twos] ^ x[twos + 1]) <= MOST_APART]
        a.append(x[near + 1])
        b.append(x[near])
        for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
            group = np.unique(x[s:e])
            root = nearby(group)
            other = np.flatnonzero(root != np.arange(len(group)))
            a.append(group[other])
            b.append(group[root[other]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            rows += batch.num_rows
            if rows < HELD:
                continue
            c, k, x = (np.concatenate(v) for v in zip(*held, strict=True))
            cut = int(np.flatnonzero((c != c[-1]) | (k != k[-1]))[-1]) + 1 if (c[0] != c[-1] or k[0] != k[-1]) else 0
            if cut:
                yield forest(c[:cut], k[:cut], x[:cut].view(np.uint64))
            held, rows = [[c[cut:], k[cut:], x[cut:]]], len(c) - cut
        if rows:
            c, k, x = (np.concatenate(v) for v in zip(*held, strict=True))
            yield forest(c, k, x.view(np.uint64))

    return keyed.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the smallest node that it is connected with.

    Large-star and small-star steps in turn, staged after each round, until the edges stay the same.
    Nodes without an edge are not returned. Minima are aggregated before a shuffle, and the joins that
    follow can be split where a node has many edges; no neighbourhood is collected.
    """

    def state(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    now = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = state(now)
    for _ in range(most_rounds):
        if not was[0]:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(lower, large["a"] == lower["u"]).select(F.col("b").alias("x"), "m").where("x != m").select(F.col("x").alias("a"), F.col("m").alias("b"))
        after = staged(small.union(lower.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        is_now = state(after)
        now = after
        if is_now == was:
            break
        was = is_now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))


def close_fingerprints(unique: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): a forest of the pairs of the distinct fingerprints fp that are within MOST_APART bits, from the blocks that they share.

    unique is read several times and should be a written table.
    """
    each = masks(blocks)
    keyed = unique.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in each])).alias("c", "k")).select("c", "k", "fp")
    crowded = staged(keyed.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > COMPARED).select("c", "k"), "crowded")
    if not crowded.isEmpty():
        finer = F.get(F.array(*[F.array(*map(F.lit, finer_masks(m, blocks))) for m in each]), F.col("c"))
        split = keyed.join(crowded, ["c", "k"], "left_semi").select("c", "fp", F.posexplode(F.transform(finer, lambda m: F.col("fp").bitwiseAND(m))).alias("s", "k"))
        named = (F.col("c") + 1) * len(each) + F.col("s")  # beyond the numbers of `masks`
        keyed = keyed.join(crowded, ["c", "k"], "left_anti").select("c", "k", "fp").union(split.select(named.alias("c"), "k", "fp"))
    return links(keyed.repartition("c", "k").sortWithinPartitions("c", "k", "fp"))


def near_duplicates(docs: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) for every row of docs."""
    own = staged(fingerprints(docs), "fingerprints")
    unique = staged(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique")
    root = components(close_fingerprints(unique, blocks))
    rooted = unique.join(root, unique["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return own.join(by_fp, own["fp"] == by_fp["__fp"], "left").select("doc_id", "fp", "component_id")
