"""Exact top-k search by MaxScore over the components of integer vectors.

A vector's terms are its components; a term's posting lists hold the vectors in which it is positive or
negative. For a query, terms are ordered by the most that they can add to a score in a shard. Terms at
the end whose bounds together stay below the query's threshold, the k-th best score that it has so far, are
non-essential: a vector that is in no posting list of an essential term can't be among the k best. Essential
postings are traversed; then vectors are probed in the order of what they can still reach, a few at a time, and
the threshold rises with them, until the next can't compete. The shards' k best are merged.

Vectors of like length are dealt to shards by a hash; a shard is bounded in rows and in components, so that one very long vector widens
none but its own. Each shard is put together where its vectors arrive, once, and written. Queries go
through the shards in blocks of bounded size, sent to every task. A task carries its block's k best from shard to
shard. Shards are taken in groups, each GROWTH times the last; what a group's shards found gives the thresholds
with which the next begins. So a shard of a later group returns little: about k * GROWTH answers a query leave
each group however many shards it has, and no vector is copied for a query or a query for a vector in a shuffle.

A term's two posting lists are the positive and the negative part of a column, and the essential ones of some queries are traversed together, as a
product of matrices. Sums are of whole numbers, in the smallest kind of number that holds all of them exactly.

Every row whose id is divisible by `every` is a query of its own, and every other row its candidate. Rows that
repeat both id and vector are kept as one with their number, and each of them gets the same answer.

Cases: a null vector, or one that holds null, NaN or an infinity, takes no part, nor does a row without an
id; vectors that are shorter than others lack the terms (0); an empty vector scores 0; rows that share an id
are candidates of each other; ties go to the smaller id; other columns are ignored. Scores beyond 64 bits are
held at the limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

K, EVERY, SCALE = 5, 50, 256
SHARD_ROWS, SHARD_VALUES, BLOCK_VALUES, GROWTH, MOST_TASKS = 8192, 1 << 20, 1 << 22, 16, 20_000
PROBED, TOGETHER = 128, 64
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components times `scale` rounded down, of the rows that take part."""
    broken = F.exists(F.col(vector_column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(F.col(vector_column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & ~broken).select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("v"))


def matrix(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Vectors, one after another, as rows that are filled with zeros or cut to a width."""
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = column < width
    out[row[kept], column[kept]] = flat[kept]
    return out


def exact(q: np.ndarray, v: np.ndarray) -> int:
    return max(LOW, min(HIGH, sum(int(a) * int(b) for a, b in zip(q, v, strict=True))))


class Shard:
    """Posting lists and term bounds of the vectors `v` with ids `ids`, each there `times` times."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, times: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.v, self.times = ids[order], v[order], times[order]
        self.high, self.low = np.maximum(self.v.max(0, initial=0), 0), np.minimum(self.v.min(0, initial=0), 0)
        self.largest = int(max(self.high.max(initial=0), -int(self.low.min(initial=0))))
        self.parts: dict[type, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def lists(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors, and the weights of their positive and of their negative terms, which are the posting lists."""
        if kind not in self.parts:
            self.parts[kind] = self.v.astype(kind), np.maximum(self.v, 0).astype(kind), np.minimum(self.v, 0).astype(kind)
        return self.parts[kind]

    def best(self, own: int, q: np.ndarray, k: int, found: list[tuple[int, int]], threshold: int | None = None) -> list[tuple[int, int]]:
        """The k best (-score, id) of `found` and of this shard's vectors but the query's own row; with a threshold from elsewhere lower ones may lack."""
        return self.search(np.array([own]), q[None, :], k, [found], None if threshold is None else [threshold])[0]

    def search(self, own: np.ndarray, q: np.ndarray, k: int, found: list[list[tuple[int, int]]], thresholds: list[int] | None = None) -> list[list[tuple[int, int]]]:
        """best for each of some queries, rows of q that are as wide as the shard; what is shorter or longer adds nothing."""
        top = int(np.abs(q).max(initial=0)) * self.largest * max(1, q.shape[1])
        if top >= 1 << 62:
            return [self.plain(name, row, k, best) for name, row, best in zip(own.tolist(), q, found, strict=True)]
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64
        v, positive, negative = self.lists(kind)
        out = [sorted(best)[:k] for best in found]
        floors = [max([x for x in (None if thresholds is None else thresholds[i], -best[-1][0] if len(best) >= k else None) if x is not None], default=LOW) for i, best in enumerate(out)]
        floor = np.array(floors)[:, None]
        # Terms from the one with the highest bound on; rest: what they can add from each place on.
        bound = np.where(q > 0, q * self.high, q * self.low)
        order = np.argsort(-bound, axis=1, kind="stable")
        rest = np.cumsum(np.take_along_axis(bound, order, 1)[:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([rest, np.zeros((len(q), 1), np.int64)], axis=1)
        essential = (rest >= floor).sum(1)  # beyond all terms: a vector that has none of them can compete
        base = np.take_along_axis(rest, np.minimum(essential, q.shape[1])[:, None], 1)
        taken = np.zeros(q.shape, bool)
        np.put_along_axis(taken, order, np.arange(q.shape[1])[None, :] < essential[:, None], 1)
        weights = np.where(taken, q, 0)
        reach = np.maximum(weights, 0).astype(kind) @ positive.T + np.minimum(weights, 0).astype(kind) @ negative.T
        touched = (reach > 0) | (essential > q.shape[1])[:, None]
        reach += base.astype(kind)
        queries = q.astype(kind)
        for i, name in enumerate(own.tolist()):
            least, best = floors[i], out[i]
            candidates = np.flatnonzero(touched[i] & (reach[i] >= least))
            step = max(PROBED, 4 * k)
            while len(candidates):
                near = reach[i, candidates]
                if len(candidates) > step:  # those that reach highest, in no order among them
                    lead = np.argpartition(-near, step - 1)
                    probed, candidates = candidates[lead[:step]], candidates[lead[step:]]
                else:
                    probed, candidates = candidates, candidates[:0]
                score = v[probed] @ queries[i] if 4 * len(probed) < len(v) else (v @ queries[i])[probed]
                score = score.astype(np.int64)
                if least > LOW:
                    high = score >= least
                    probed, score = probed[high], score[high]
                first = np.lexsort((self.ids[probed], -score))[: 2 * k + 1]
                left = self.left(name, q[i], probed[first])
                for s, n, times in zip(score[first].tolist(), self.ids[probed[first]].tolist(), left.tolist(), strict=True):
                    best += [(-s, n)] * min(times, k)
                best = sorted(best)[:k]
                if len(best) >= k and -best[-1][0] > least:
                    least = -best[-1][0]
                    candidates = candidates[reach[i, candidates] >= least]
                step *= 4
            out[i] = best
        return out

    def plain(self, own: int, q: np.ndarray, k: int, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Every score, where sums don't fit 64 bits."""
        scored = [(-exact(q, row), i) for i, row, n in zip(self.ids.tolist(), self.v, self.left(own, q).tolist(), strict=True) for _ in range(min(n, k))]
        return sorted(found + scored)[:k]

    def left(self, own: int, q: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """How often each vector is a candidate: the query's own row isn't one."""
        ids, times = (self.ids, self.times) if at is None else (self.ids[at], self.times[at])
        same = np.flatnonzero(ids == own)
        if len(same):
            times = times.copy()
            rows = self.v[same] if at is None else self.v[at[same]]
            times[same[(rows == q).all(1)]] -= 1
        return times


def dealt(rows: DataFrame, shard_rows: int, shard_values: int) -> tuple[DataFrame, int]:
    """shard, vec_id, v and times of the distinct rows, and the number of shards, which hold vectors of like length."""
    # Lengths are alike if they have as many binary digits.
    digits = F.length(F.bin(F.size("v")))
    sizes = rows.groupBy(digits.alias("digits")).agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).collect()  # some 30 rows at most
    shard, shards = F.lit(0).cast("long"), 0
    for r in sorted(sizes, key=lambda r: r["digits"]):
        own = max(1, -(-r["n"] // shard_rows), -(-r["n"] * max(1, r["width"]) // shard_values))
        shard = F.when(digits == r["digits"], shards + F.pmod(F.xxhash64("vec_id", "v"), F.lit(own))).otherwise(shard)
        shards += own
    return rows.groupBy("vec_id", "v").agg(F.count("*").alias("times")).select(shard.alias("shard"), "vec_id", "v", "times"), shards


def pack(rows: DataFrame, tasks: int) -> DataFrame:
    """One row for each shard of rows (shard, vec_id, v, times): its ids, lengths, components and numbers as bytes."""
    names = ["shard", "ids", "sizes", "v", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = -1, []

        def made() -> pa.RecordBatch:
            joined = [np.concatenate(x).astype(np.int64).tobytes() for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *[pa.array([x], pa.binary()) for x in joined]], names=names)

        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                if b > a:
                    if numbers[a] != shard and held:
                        yield made()
                        held = []
                    shard, part = int(numbers[a]), batch.slice(a, b - a)
                    lists = part.column("v")
                    held.append((part.column("vec_id").to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False), part.column("times").to_numpy()))
        if held:
            yield made()

    task = F.expr(f"cast(shard % {tasks} as int)")
    return rows.repartitionById(tasks, task).sortWithinPartitions("shard").mapInArrow(run, "shard long, ids binary, sizes binary, v binary, times binary")


def searched(shards: DataFrame, k: int, own: np.ndarray, sizes: np.ndarray, flat: np.ndarray, thresholds: np.ndarray | None) -> DataFrame:
    """(q, vec_id, score): for each query, by its place in the block, the best of the shards that a task holds."""
    sent = shards.sparkSession.sparkContext.broadcast((own, sizes, flat, thresholds))  # of bounded size: a block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sizes, flat, thresholds = sent.value
        starts = np.r_[0, np.cumsum(sizes)]
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        for batch in batches:
            for columns in zip(*[batch.column(c) for c in ("ids", "sizes", "v", "times")], strict=True):
                ids, lengths, v, times = (np.frombuffer(x.as_buffer(), np.int64) for x in columns)
                width = int(lengths.max(initial=0))
                shard = Shard(ids, matrix(v, lengths, width), times)
                for at in range(0, len(own), TOGETHER):
                    some = slice(at, min(at + TOGETHER, len(own)))
                    q = matrix(flat[starts[some.start] : starts[some.stop]], sizes[some], width)
                    known = None if thresholds is None else thresholds[some].tolist()
                    best[some] = shard.search(own[some], q, k, best[some], known)
        for at in range(0, len(best), 4096):
            rows = [(at + i, n, -s) for i, found in enumerate(best[at : at + 4096]) for s, n in found]
            q, names, scores = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(names, pa.int64()), pa.array(scores, pa.int64())], names=["q", "vec_id", "score"])

    return shards.select("ids", "sizes", "v", "times").mapInArrow(run, "q long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(
    vectors: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, shard_values: int = SHARD_VALUES, block_values: int = BLOCK_VALUES, growth: int = GROWTH, **columns
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of each query, a row whose id is divisible by `every`."""
    spark, rows = vectors.sparkSession, usable(vectors, **columns)
    whole, shards = dealt(rows, shard_rows, shard_values)
    packed = staged(pack(whole, max(1, min(shards, MOST_TASKS))), "shards")
    # Rows that repeat a query's id and vector are one query, answered for each of them.
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    asked = staged(asked, "queries")
    values = asked.agg(F.sum(F.greatest(F.size("v"), F.lit(1))).alias("n")).first()["n"] or 0
    blocks = -(-values // block_values)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.lit("block")), F.lit(max(1, blocks))))
    answers = []
    for block in range(blocks):
        held = asked.where(F.col("block") == block).orderBy("vec_id", "v").toPandas()
        if not len(held):
            continue
        own, sizes = held["vec_id"].to_numpy(np.int64), np.array([len(v) for v in held["v"]], np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *held["v"]]).astype(np.int64)
        thresholds, first, last, parts = None, 0, growth, []
        while first < shards:
            group = packed.where((F.col("shard") >= first) & (F.col("shard") < last))
            parts.append(staged(ranked(searched(group, k, own, sizes, flat, thresholds), k).drop("rank"), "found"))
            first, last = last, last * growth
            if first < shards:
                thresholds = np.full(len(own), LOW)
                sofar = ranked(reduce(DataFrame.unionByName, parts), k).where(F.col("rank") == k).select("q", "score").toPandas()
                thresholds[sofar["q"].to_numpy(np.int64)] = sofar["score"].to_numpy(np.int64)
        names = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(own)), "query_id": own, "times": held["times"].to_numpy(np.int64)}), "q long, query_id long, times long")
        each = ranked(reduce(DataFrame.unionByName, parts), k).join(names, "q")
        copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
        answers.append(staged(each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", copies.alias("copy")).drop("copy"), "answers"))
    if not answers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, answers)
