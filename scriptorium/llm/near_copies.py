"""Near copies by the rule for stages: sets of five-word shingles whose Jaccard similarity is 0.8 or more.

Words are lower-cased bytes between ASCII white space, as in SimHash. The SimHash operator comes first: fingerprints of the
five-word shingles, pigeonhole blocks, Hamming distances; each of its links is held against the shingle sets (64-bit hashes of
shingles) and stays if they are similar enough. Fingerprints of texts at similarity 0.8 differ by some ten bits, out of reach
of blocks. So a MinHash sketch of BANDS bands of ROWS values names the other candidates: two texts of similarity s share a band
with probability 1 - (1 - s**ROWS)**BANDS, 0.9999 at 0.8. These, too, are verified on the sets.

First the members of a bucket are held against its hub, the member with the most candidates, as copies of one text are nearer
to it than to each other. Then all pairs of a bucket that are still in different components, unless counts alone rule them out: a
shingle that only one open text has is in no intersection, so the others, counted by BINS ranges of hashes, bound it, by range the
smaller of both counts. Pairs within a component change nothing, so components are those of all verified pairs that share a bucket.

Cases: a text of fewer than five words has one shingle, one without words has none and equals its like;
equal sets meet as one (named by a 64-bit hash of the set). Rows that repeat a doc_id keep a row each; rows
without a doc_id are left out. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .simhash import close_fingerprints, components, fingerprint_of, shingle_hashes

SHINGLE, LEAST, SEED = 5, 0.8, 42
BANDS, ROWS, BINS = 24, 5, 32


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(shingle_hashes(text, shingle, SEED))


def set_id(hashes: np.ndarray) -> int:
    """The name of a set of shingles, as a signed 64-bit integer."""
    import xxhash

    n = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return n - (1 << 64) if n >> 63 else n


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A signed 64-bit key for each band of the set's MinHash sketch; none for the empty set."""
    import xxhash

    if not len(hashes):
        return np.empty(0, np.int64)
    rng = np.random.default_rng(SEED)
    factors, terms = (rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) for _ in range(2))
    factors = factors * np.uint64(2) + np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096, None]
        mixed = (part ^ (part >> np.uint64(32))) * factors + terms
        least = np.minimum(least, (mixed >> np.uint64(16)).min(0))
    return np.array([xxhash.xxh64_intdigest(least[i * rows : (i + 1) * rows].tobytes(), i) for i in range(bands)], np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, sid (the name of the set of shingles), n (its size), fp (the SimHash) and keys (of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                all_ = [shingle_hashes(x, shingle, SEED) for x in part.column("text").to_pylist()]
                sets = [np.unique(h) for h in all_]
                keys = pa.array([band_keys(s, bands, rows) for s in sets], pa.list_(pa.int64()))
                fps = np.array([fingerprint_of(h) for h in all_], np.uint64).view(np.int64)
                columns = [part.column("doc_id"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.int64()), keys]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sid", "n", "fp", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sid long, n long, fp long, keys array<long>")


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """sid and hashes, the set of shingles as bytes, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(x, shingle) for x in batch.slice(at, 512).column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "hashes"])

    return docs.select("text").mapInArrow(run, "sid long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x, y = ([np.frombuffer(v, "<u8") for v in part.column(c).to_pylist()] for c in ("x", "y"))
                near = pa.array([similarity(p, q) >= least for p, q in zip(x, y, strict=True)], pa.bool_())
                yield part.select(["a", "b"]).filter(near)

    first, second = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def bin_of(h: Column, bins: int) -> Column:
    """The range that a 64-bit hash lies in; bins is a power of two."""
    return F.shiftrightunsigned(h, 64 - (bins.bit_length() - 1)).cast("int")


def shared_counts(sets: DataFrame, bins: int = BINS) -> DataFrame:
    """sid, n and c0, ...: by range of hashes, how many of the set's shingles another of the sets has, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                each = [np.frombuffer(v, "<i8") for v in part.column("hashes").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("sid").to_numpy(), [len(h) for h in each])), pa.array(np.concatenate(each))], names=["sid", "h"])

    alone = sets.select("sid", "hashes").mapInArrow(run, "sid long, h long").groupBy("h").agg(F.count("*").alias("n"), F.min("sid").alias("sid")).where("n = 1")
    lost = alone.groupBy("sid").agg(*[F.sum((bin_of(F.col("h"), bins) == b).cast("int")).alias(f"u{b}") for b in range(bins)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.frombuffer(v, "<u8") for v in batch.column("hashes").to_pylist()]
            held = np.array([np.bincount((h >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64), minlength=bins) for h in each]).reshape(len(each), bins)
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([len(h) for h in each], pa.int64()), *[pa.array(held[:, b], pa.int64()) for b in range(bins)]], names=["sid", "n", *[f"t{b}" for b in range(bins)]])

    total = sets.select("sid", "hashes").mapInArrow(count, "sid long, n long, " + ", ".join(f"t{b} long" for b in range(bins)))
    return total.join(lost, "sid", "left").select("sid", "n", *[(F.col(f"t{b}") - F.coalesce(f"u{b}", F.lit(0))).alias(f"c{b}") for b in range(bins)])


def may_reach(least: float, most: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m things with at most `most` in common can have a similarity of `least`."""
    return most * (1 + least) + 1e-6 >= least * (n + m)


def near_copies(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, bins: int = BINS) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable by near copies) for every row of docs that has a doc_id."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    own = staged(sketches(named, shingle, bands, rows), "sketches")
    unique = staged(own.groupBy("sid").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.max("n").alias("n")), "unique")

    # SimHash: of each fingerprint one set stands for all, and these for their forest.
    by_fp = staged(unique.groupBy("fp").agg(F.min("sid").alias("head")), "fingerprints")
    same = unique.join(by_fp, "fp").where("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    forest = staged(close_fingerprints(by_fp.select("fp")), "forest")
    heads = [by_fp.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab"]
    close = forest.join(heads[0], "a").join(heads[1], "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))

    # Buckets of two sets and more, and the hub of each.
    each = own.select("sid", "n", F.posexplode("keys").alias("band", "key")).distinct()
    sizes = each.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    shared = staged(each.join(sizes, ["band", "key"]), "buckets")
    degrees = shared.groupBy("sid").agg(F.sum("size").alias("degree"))
    hubs = shared.join(degrees, "sid").groupBy("band", "key").agg(F.max(F.struct("degree", "sid", "n")).alias("top")).select("band", "key", F.col("top.sid").alias("hub"), F.col("top.n").alias("hub_n"))
    star = shared.join(hubs, ["band", "key"]).where((F.col("sid") != F.col("hub")) & may_reach(least, F.least("n", "hub_n"), F.col("n"), F.col("hub_n"))).select(F.col("sid").alias("a"), F.col("hub").alias("b"))

    first = staged(same.union(close).union(star).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "candidates")
    met = shared.select("sid").union(first.select("a")).union(first.select("b")).distinct().join(unique, "sid").select(F.col("first").alias("doc_id")).distinct()
    sets = staged(sets_of(named.join(met, "doc_id", "left_semi"), shingle).dropDuplicates(["sid"]), "sets")
    links = staged(verified(first, sets, least), "links")
    known = staged(components(links), "known")

    # What is left between components.
    labelled = shared.join(known, shared["sid"] == known["node"], "left").select("band", "key", "sid", F.coalesce("root", "sid").alias("root"))
    mixed = labelled.groupBy("band", "key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("band", "key")
    open_ = staged(labelled.join(mixed, ["band", "key"], "left_semi"), "open")
    counts = staged(shared_counts(sets.join(open_.select("sid").distinct(), "sid", "left_semi"), bins), "counts")
    able = staged(open_.join(counts, "sid").where(may_reach(least, reduce(lambda x, y: x + y, [F.col(f"c{b}") for b in range(bins)]), F.col("n"), F.ceil(F.col("n") * least))), "able")
    p, q = (able.select("band", "key", *[F.col(c).alias(f"{s}_{c}") for c in able.columns if c not in ("band", "key")]) for s in ("a", "b"))
    most = reduce(lambda x, y: x + y, [F.least(f"a_c{b}", f"b_c{b}") for b in range(bins)])
    rest = p.join(q, ["band", "key"]).where((F.col("a_sid") > F.col("b_sid")) & (F.col("a_root") != F.col("b_root")) & may_reach(least, most, F.col("a_n"), F.col("b_n")))
    rest = staged(rest.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b")).distinct(), "rest")
    root = components(links.union(verified(rest, sets, least)))
    rooted = unique.join(root, unique["sid"] == root["node"], "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_set = rooted.join(smallest, "root").select("sid", "component_id")
    return own.select("doc_id", "sid").join(by_set, "sid").select("doc_id", "component_id")
