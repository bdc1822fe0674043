"""Toxicity: a counterfactual-regularised classifier.

A sparse logistic model over which words, and which first letters of words, occur in a text; features may speak
for either class. Each labelled text that mentions a group is rewritten: a mention is swapped for each other term
of its family, and for none, and the rewritten text is turned into features again. The fit adds the squared change
of the log odds from the text to its rewritten ones, whatever features that change touches (a swap to a term that
the text has already only takes one away), so that a mention alone moves no score.

Training reads at most `toxic_rows` toxic and `clean_rows` other labelled rows in expectation, by a hash
of doc_id, never held-out ones; labels travel to the documents. Features are counted on the executors; what reaches the driver is those
features of these rows that can have a weight at all, which a feature of a few rows can't. The fit works on some, tests the
conditions of the optimum on all others, and goes on with those that break them until none does.

Cases: null, empty and blank texts are scored by the intercept alone; rows without a label aren't learned
from; without labels of both kinds every score is the share of toxic labels (0 without any); repeated
rows and null doc_ids are scored like any other; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, staged

TOXIC_ROWS, CLEAN_ROWS = 4000, 8000
SPARSE, COUNTERFACTUAL = 4e-4, 1.0
#: Steps of a round, and the move of a weight below which they end. This stops short of the optimum: on sf0.001 the loss is 4.6% above it, on held-out
#: labels of sf0.1 it misses 10 of 97 toxic texts and marks 4 of 728 others, the optimum (3000 and 1e-6) 12 and 5.
STEPS, SETTLED = 300, 1e-4
PREFIXES = (4, 5)
WORD = re.compile(r"[^\W\d_]+")

#: Families of terms that name groups; each may be swapped for another of its family.
IDENTITY = (
    "women men girls boys females males mothers fathers transgender nonbinary".split(),
    "woman man girl boy female male mother father".split(),
    "he she they".split(),
    "muslim christian jewish hindu buddhist atheist catholic sikh".split(),
    "muslims christians jews hindus buddhists atheists catholics sikhs".split(),
    "black white asian african european latino hispanic arab indigenous".split(),
    "gay lesbian bisexual straight queer heterosexual".split(),
    "immigrants refugees foreigners natives citizens migrants".split(),
    "mexican chinese indian german french spanish english american russian japanese".split(),
    "old young elderly teenage".split(),
    "blind deaf disabled autistic".split(),
    "frauen männer mädchen jungen".split(),
    "muslime christen juden flüchtlinge ausländer deutsche".split(),
    "femmes hommes filles garçons".split(),
    "musulmans chrétiens juifs réfugiés étrangers français".split(),
    "mujeres hombres niñas niños".split(),
    "musulmanes cristianos judíos refugiados extranjeros españoles".split(),
)
FAMILY = {t: k for k, family in enumerate(IDENTITY) for t in family}
#: A first-letters feature that a mention could set is no feature.
IDENTITY_PREFIXES = {t[:k] for t in FAMILY for k in PREFIXES if len(t) >= k}


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def features(found: set[str]) -> set[str]:
    """Words, and first letters marked by a trailing dash."""
    return found | {w[:k] + "-" for w in found for k in PREFIXES if len(w) > k and w[:k] not in IDENTITY_PREFIXES}


@dataclass
class Model:
    bias: float = -30.0
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        weights = self.weights
        z = self.bias + sum([weights[f] for f in features(words(text)) if f in weights])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def hashed(feature: str) -> int:
    """The feature's XXH64 with Spark's seed, as Spark's xxhash64 has it."""
    import xxhash

    n = xxhash.xxh64_intdigest(feature, 42)
    return n - (1 << 64) if n >> 63 else n


def swapped(found: set[str]) -> list[set[str]]:
    """The words of a text, rewritten: each mention swapped for each other term of its family, and for none."""
    return [(found - {t}) | ({u} if u else set()) for t in sorted(found & FAMILY.keys()) for u in [*IDENTITY[FAMILY[t]], ""] if u != t]


@dataclass
class Rows:
    """Sparse rows: entry i has the value `value[i]` (1 if None) at row `row[i]` and feature `to[i]`."""

    row: np.ndarray
    to: np.ndarray
    n: int
    value: np.ndarray | None = None

    def times(self, w: np.ndarray) -> np.ndarray:
        held = w[self.to]
        return np.bincount(self.row, held if self.value is None else held * self.value, self.n)

    def back(self, x: np.ndarray, features: int) -> np.ndarray:
        held = x[self.row]
        return np.bincount(self.to, held if self.value is None else held * self.value, features)

    def only(self, active: np.ndarray) -> Rows:
        number = (np.cumsum(active) - 1).astype(np.int32)
        keep = active[self.to]
        return Rows(self.row[keep], number[self.to[keep]], self.n, None if self.value is None else self.value[keep])

    def steepness(self, weight: np.ndarray, features: int) -> np.ndarray:
        """A bound for each feature of the curvature that the rows, weighted, give a quadratic."""
        size = np.abs(self.value) if self.value is not None else np.ones(len(self.to))
        each = np.bincount(self.row, size, self.n) * weight
        return np.bincount(self.to, size * each[self.row], features)


def fit(x: Rows, labels: np.ndarray, features: int, changes: Rows, shares: np.ndarray, sparse: float = SPARSE, counterfactual: float = COUNTERFACTUAL, steps: int | None = None, rounds: int = 12) -> tuple[float, np.ndarray]:
    """Bias and weights that make mean log loss + sparse * |w|_1 + counterfactual * sum(shares * (changes w)^2) least, as far as STEPS and SETTLED go.

    Classes weigh by the square root of their inverse share. Accelerated proximal steps, each feature at its own rate, run on an active set of
    features; those outside whose slope passes `sparse` come in, until there is none.
    """
    share = labels.mean()
    balance = np.where(labels > 0, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    balance /= balance.sum()
    w, bias = np.zeros(features), float(np.log(share / (1 - share)))

    def slope(z: np.ndarray) -> np.ndarray:
        return balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)

    active = np.zeros(features, bool)
    for _ in range(rounds):
        error = slope(bias + x.times(w))
        full = x.back(error, features) + 2 * counterfactual * changes.back(shares * changes.times(w), features)
        new = ~active & (np.abs(full) > sparse * (1 if active.any() else 0.6))
        if not new.any() and active.any():
            break
        active |= new
        k = int(active.sum())
        own, moved = x.only(active), changes.only(active)
        # The intercept, as one feature more of every row, takes part in each row's bound.
        rate = 1 / (own.steepness(0.25 * balance, k) + np.bincount(own.to, 0.25 * balance[own.row], k) + 2 * counterfactual * moved.steepness(shares, k) + 1e-12)
        bias_rate = 1 / (0.25 * (balance * (1 + np.bincount(own.row, minlength=own.n))).sum())
        at, look, look_bias, t = w[active], w[active].copy(), bias, 1.0
        for _ in range(STEPS if steps is None else steps):
            error = slope(look_bias + own.times(look))
            step = own.back(error, k) + 2 * counterfactual * moved.back(shares * moved.times(look), k)
            after = look - rate * step
            after = np.sign(after) * np.maximum(np.abs(after) - rate * sparse, 0)
            after_bias = look_bias - bias_rate * error.sum()
            if ((after - look) * (at - after)).sum() > 0:  # restart where the momentum leads uphill
                t = 1.0
            s = (1 + np.sqrt(1 + 4 * t * t)) / 2
            far = np.abs(after - at).max(initial=abs(after_bias - bias))
            look, look_bias = after + (t - 1) / s * (after - at), after_bias + (t - 1) / s * (after_bias - bias)
            at, bias, t = after, after_bias, s
            if far < SETTLED:
                break
        w[active] = at
    return float(bias), w


def able(rows: DataFrame, toxic: int, n: int, sparse: float) -> np.ndarray:
    """The hashes of features that can have a weight, in order.

    A feature's slope is at most the sum of the weights of the rows that have it; where that doesn't pass `sparse`, its weight is 0 at the optimum.
    Features that a rewriting can touch are those of the listed terms, and stay.
    """
    share = toxic / n
    weigh = {1: np.sqrt(0.5 / share), 0: np.sqrt(0.5 / (1 - share))}
    total = toxic * weigh[1] + (n - toxic) * weigh[0]
    reach = F.sum(F.when(F.col("toxic") == 1, float(weigh[1] / total)).otherwise(float(weigh[0] / total)))
    # At most the mean number of features of a row, divided by `sparse`, of them.
    found = rows.select("toxic", F.explode("own").alias("f")).groupBy("f").agg(reach.alias("reach")).where(F.col("reach") > sparse * (1 - 1e-9)).select(F.xxhash64("f").alias("h")).toPandas()
    return np.unique(np.r_[found["h"].to_numpy(np.int64), np.array([hashed(f) for f in features(set(FAMILY))], np.int64)])


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS, sparse: float = SPARSE, counterfactual: float = COUNTERFACTUAL) -> Model:
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("__id"), (F.col("toxic") > 0).cast("int").alias("__toxic"))
    sizes = {r["__toxic"]: r["n"] for r in usable.groupBy("__toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(bias=30.0 if 1 in sizes else -30.0)
    draw = F.pmod(F.xxhash64(F.col("__id"), F.lit("toxicity sample")), F.lit(1 << 20)) / (1 << 20)
    chosen = usable.where(draw < F.when(F.col("__toxic") == 1, toxic_rows / sizes[1]).otherwise(clean_rows / sizes[0]))
    # The chosen labels are bounded by the two row parameters: 12 bytes each.
    marks = F.broadcast(chosen.groupBy("__id").agg(F.max("__toxic").alias("__toxic")))
    sample = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(marks, "__id").select("__toxic", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features of each text, and by their hashes also what each rewritten one lacks or has more: its number, its sign, the feature."""
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, own, moved = batch.slice(at, 256), [], []
                for text in part.column("text").to_pylist():
                    found = words(text)
                    there = features(found)
                    own.append(sorted(there))
                    moved.append(np.array([(k, sign, hashed(f)) for k, other in enumerate(map(features, swapped(found))) for sign, more in ((-1, there - other), (1, other - there)) for f in sorted(more)], "<i8").tobytes())
                packed = [np.array([hashed(f) for f in x], "<i8").tobytes() for x in own]
                yield pa.RecordBatch.from_arrays([part.column("__toxic"), pa.array(own, pa.list_(pa.string())), pa.array(packed, pa.binary()), pa.array(moved, pa.binary())], names=["toxic", "own", "hashes", "moved"])

    rows = staged(sample.mapInArrow(read, "toxic int, own array<string>, hashes binary, moved binary"), "toxicity")
    kinds = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    if kinds["toxic"] in (0, kinds["n"]):
        return Model(bias=30.0 if kinds["toxic"] else -30.0)
    # The fewer rows, the easier a feature goes with the labels by chance.
    sparse = max(sparse, sparse * float(np.sqrt((toxic_rows + clean_rows) / kinds["n"])))
    kept = rows.sparkSession.sparkContext.broadcast(able(rows, kinds["toxic"], kinds["n"], sparse))

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept.value  # in order, and never empty
        for batch in batches:
            hashes = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column("hashes")]
            told = [x[known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x].tobytes() for x in hashes]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(told, pa.binary()), batch.column("moved")], names=["toxic", "hashes", "moved"])

    fitted = staged(rows.select("toxic", "hashes", "moved").mapInArrow(only, "toxic int, hashes binary, moved binary"), "fitted")
    labelled, own, moved = [], [], []
    for r in fitted.toLocalIterator():  # a partition at a time
        labelled.append(float(r["toxic"]))
        own.append(np.frombuffer(r["hashes"], "<i8"))
        moved.append(np.frombuffer(r["moved"], "<i8").reshape(-1, 3))
    labelled, lengths = np.array(labelled), [len(r) for r in own]
    together = np.concatenate([*own, *[m[:, 2] for m in moved]])
    del own
    to, names = pd.factorize(together)
    del together
    to, entries = to.astype(np.int32), sum(lengths)
    x = Rows(np.repeat(np.arange(len(lengths), dtype=np.int32), lengths), to[:entries], len(lengths))
    swaps = np.array([int(m[:, 0].max()) + 1 if len(m) else 0 for m in moved])
    before = np.cumsum(swaps) - swaps
    changes = Rows(np.concatenate([m[:, 0] + b for m, b in zip(moved, before, strict=True)]), to[entries:], int(swaps.sum()), np.concatenate([m[:, 1] for m in moved]).astype(float))
    shares = np.repeat(1 / np.maximum(swaps, 1), swaps) / max(1, (swaps > 0).sum())
    bias, weights = fit(x, labelled, len(names), changes, shares, sparse, counterfactual)
    held = {int(names[i]): float(weights[i]) for i in np.flatnonzero(np.abs(weights) > 1e-6)}
    spelled = rows.select(F.explode("own").alias("f")).where(F.xxhash64("f").isin(list(held))).distinct().collect() if held else []
    known = {r["f"] for r in spelled} | features(set(FAMILY))  # a rewritten text may have a term that no text has
    return Model(bias, {f: held[hashed(f)] for f in known if hashed(f) in held})


def score_documents(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, score and predicted for every whole text."""
    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = np.array([model.score(x) for x in part.column("__text").to_pylist()], float)
                columns = [*[part.column(c) for c in keep], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, schema)
