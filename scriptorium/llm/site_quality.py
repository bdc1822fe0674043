"""Quality by hierarchical empirical Bayes: document evidence, shrunk site and path posteriors.

A logistic model of a text's character and word shares, fitted to labelled documents, gives each document
a probability. Grouped aggregation sums these by site (the column `site`) and by path (site and `path`). A
site's quality is shrunk toward the global mean and a path's toward its site, each by a prior strength
that is estimated from the spread of the groups; so groups of few documents say little. The verdict adds
the path's log odds, relative to the global ones and damped by `group_weight`, to the document's.

Training reads at most `rows` labelled rows of either kind in expectation, by a hash of doc_id, never
held-out ones. Sums and posteriors cover all documents.

Cases: null, empty and blank texts have no words and are rejected (posterior 0) and count in no group;
null sites and paths are groups of their own; without labels of both kinds every text with words keeps
probability 1 (or 0 if all labels are 0); repeated rows count each; a null doc_id is judged like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, staged
from .quality_rules import STOP_WORDS

ROWS = 6000
LEAST_POSTERIOR, GROUP_WEIGHT = 0.3, 0.25
NAMES = ("bias", "log_words", "word_length", "upper", "digits", "symbols", "marks", "stop_words", "distinct", "dup_lines")
STOPS = frozenset(w.encode() for v in STOP_WORDS.values() for w in v)
CLASS = np.zeros((256, 4), bool)
CLASS[ord("A") : ord("Z") + 1, 0] = True
CLASS[ord("0") : ord("9") + 1, 1] = True
CLASS[list(b"#*$%&|<>{}[]^~_\\=+"), 2] = True
CLASS[list(b"!?;:"), 3] = True


def evidence(text: str | None) -> list[float] | None:
    """The features of one whole text; None without words."""
    whole = (text or "").encode()
    words = whole.split()
    if not words:
        return None
    counts = np.bincount(np.frombuffer(whole, np.uint8), minlength=256) @ CLASS
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in whole.split(b"\n") if x.strip()]
    return [
        1.0,
        np.log(n),
        min(20.0, chars / n) / 5,
        counts[0] / chars,
        counts[1] / chars,
        min(3.0, counts[2] / n),
        min(3.0, counts[3] / n),
        sum(map(STOPS.__contains__, words)) / n,
        len(set(words)) / n,
        1 - len(set(lines)) / len(lines),
    ]


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]

    def probability(self, rows: list[list[float] | None]) -> np.ndarray:
        """NaN for rows without evidence."""
        out = np.full(len(rows), np.nan)
        known = [i for i, r in enumerate(rows) if r is not None]
        if known:
            x = (np.array([rows[i] for i in known]) - self.center) / self.scale
            out[known] = 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -12, 12)))
        return out


def constant(p: float) -> Model:
    k = len(NAMES)
    return Model((float(np.log(p / (1 - p))), *[0.0] * (k - 1)), tuple([0.0] * k), tuple([1.0] * k))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> Model:
    """Newton steps on a ridge-penalised logistic loss."""
    center, scale = x.mean(0), x.std(0)
    center[0], scale[0] = 0.0, 1.0
    scale[scale < 1e-9] = 1.0
    z, w = (x - center) / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + ridge * w
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return Model(tuple(map(float, w)), tuple(map(float, center)), tuple(map(float, scale)))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("__id"), (F.col("quality") > 0).cast("int").alias("__good"))
    sizes = {r["__good"]: r["n"] for r in usable.groupBy("__good").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return constant(1e-6 if 0 in sizes else 1 - 1e-6)
    draw = F.pmod(F.xxhash64(F.col("__id"), F.lit("quality sample")), F.lit(1 << 20)) / (1 << 20)
    chosen = usable.where(draw < F.when(F.col("__good") == 1, rows / sizes[1]).otherwise(rows / sizes[0])).dropDuplicates(["__id"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.array(found, pa.list_(pa.float64()))], names=["good", "x"])

    # The chosen labels are bounded by twice `rows`: 12 bytes each.
    sample = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(chosen), "__id").select(F.col("__good").alias("good"), "text")
    got = [r for r in sample.mapInArrow(measure, "good int, x array<double>").collect() if r["x"] is not None]
    y = np.array([r["good"] for r in got], float)
    if len(set(y)) < 2:
        return constant(1e-6 if len(y) and not y[0] else 1 - 1e-6)
    return fit(np.array([r["x"] for r in got], float), y)


def with_probability(docs: DataFrame, model: Model, keep: list[str], name: str) -> DataFrame:
    """The columns `keep` of docs and the document's own probability, null without words."""
    source = docs.select(*keep, F.col("text").alias("__whole"))
    schema = T.StructType([source.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                p = model.probability([evidence(x) for x in part.column("__whole").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(p, pa.float64(), mask=np.isnan(p))], names=[*keep, name])

    return source.mapInArrow(run, schema)


def strength(groups: DataFrame, mean: str) -> float:
    """Prior strength of a beta prior around `mean`, from the spread of the groups' shares (columns k, n); method of moments."""
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col(mean), 2)).alias("spread"),
        F.sum(F.col("n") * F.col(mean) * (1 - F.col(mean))).alias("within"),
        F.sum(F.col("n") * F.col("n")).alias("squares"),
    ).first()
    if not row["groups"] or row["groups"] < 2 or not row["within"]:
        return 1000.0
    within = row["within"] / row["n"]
    between = (row["spread"] - row["groups"] * within) / max(1e-9, row["n"] - row["squares"] / row["n"])
    return float(np.clip(within / between - 1, 2.0, 1e6)) if between > 1e-12 else 1e6


def posteriors(scored: DataFrame, site: str, path: str) -> DataFrame:
    """One row per path of a site: its log odds relative to the global ones, after shrinking."""
    cells = staged(scored.where(F.col("p").isNotNull()).groupBy(F.col(site).alias("site"), F.col(path).alias("path")).agg(F.sum("p").alias("k"), F.count("*").cast("double").alias("n")), "paths")
    whole = cells.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    overall = min(1 - 1e-6, max(1e-6, (whole["k"] or 0.0) / (whole["n"] or 1.0)))
    sites = cells.groupBy("site").agg(F.sum("k").alias("k"), F.sum("n").alias("n")).withColumn("overall", F.lit(overall))
    by_site = strength(sites, "overall")
    sites = sites.select(F.col("site").alias("s"), ((F.col("k") + by_site * overall) / (F.col("n") + by_site)).alias("site_mean"))
    joined = cells.join(sites, cells["site"].eqNullSafe(sites["s"])).drop("s")
    by_path = strength(joined, "site_mean")
    mean = (F.col("k") + by_path * F.col("site_mean")) / (F.col("n") + by_path)
    odds = lambda p: F.log(F.greatest(F.lit(1e-6), p)) - F.log(F.greatest(F.lit(1e-6), 1 - p))
    return staged(joined.select("site", "path", "site_mean", mean.alias("path_mean"), (odds(mean) - float(np.log(overall / (1 - overall)))).alias("lift")), "posteriors")


def site_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), site: str = "source", path: str = "lang", least: float = LEAST_POSTERIOR, group_weight: float = GROUP_WEIGHT) -> DataFrame:
    """The columns `keep` of docs, document_score, site_mean, path_mean, posterior and kept.

    Columns are held apart from those of docs while they are joined, so any names may stand in docs but
    the ones returned, which replace columns of the same name.
    """
    model = train(docs, labels)
    named = docs.select("text", F.col(site).alias("__site"), F.col(path).alias("__path"), *[c for c in dict.fromkeys(keep) if c != "text"])
    # Each text is measured once; sums and verdicts read what is written here.
    scored = staged(with_probability(named, model, ["__site", "__path", *dict.fromkeys(keep)], "__p"), "scored")
    groups = posteriors(scored.select("__site", "__path", F.col("__p").alias("p")), "__site", "__path")
    joined = scored.join(groups.toDF("__s", "__t", "__site_mean", "__path_mean", "__lift"), F.col("__site").eqNullSafe(F.col("__s")) & F.col("__path").eqNullSafe(F.col("__t")), "left")
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("__p")))
    z = F.log(p) - F.log(1 - p) + group_weight * F.coalesce(F.col("__lift"), F.lit(0.0))
    posterior = F.when(F.col("__p").isNotNull(), 1 / (1 + F.exp(-z))).otherwise(0.0)
    out = [c for c in dict.fromkeys(keep) if c not in ("document_score", "site_mean", "path_mean", "posterior", "kept")]
    return joined.select(*out, F.coalesce("__p", F.lit(0.0)).alias("document_score"), F.col("__site_mean").alias("site_mean"), F.col("__path_mean").alias("path_mean"), posterior.alias("posterior"), (posterior >= least).alias("kept"))
