"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A vector of three characters binds the letters' vectors,
permuted by their places, by multiplication; a text bundles the vectors of its three-character windows by
addition, each as often as the square root of its occurrences, so that a line said many times doesn't
speak for the whole; a language bundles its training texts in the same way. A text gets the language whose prototype has
the largest cosine with it; the score is that cosine, at least 0.

Texts are lower-cased, and each run of characters that aren't letters counts as one gap. a to z have a vector
each; other letters are dealt to the PLACES - 27 others by a hash of their code points.

Training reads at most `per_language` documents of each language in expectation, taken by a hash of
doc_id, never held-out ones. As bundling is a sum, each task bundles its texts into one vector a language, and
these vectors are added up by place; weights are whole multiples of 1/GRAIN, so the sums are the same in any order.
The driver gets DIMENSIONS numbers for each language that occurs: its size is that of the label set.

Cases: null texts and texts without a letter get `und` and score 0; null languages aren't learned from;
without any labelled text every prediction is `und`; ties go to the language that sorts first; repeated
rows and null doc_ids are predicted like any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, staged

DIMENSIONS, WINDOW, PLACES = 1024, 3, 1024
GRAIN = 1024
PER_LANGUAGE = 4000
SEED = 20240229
UNKNOWN = "und"


def letter_places() -> np.ndarray:
    """For every code point the number of its vector: 0 for no letter, 1 to 26 for a to z, else one of the others."""
    table = np.zeros(0x110000, np.uint16)
    for point in range(0x110000):
        if chr(point).isalpha():
            table[point] = 27 + point * 2654435761 % 2**32 * (PLACES - 27) // 2**32
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


class Space:
    """Letter vectors and the profiles made of them."""

    def __init__(self, table: np.ndarray | None = None, dimensions: int = DIMENSIONS, seed: int = SEED):
        letters = np.random.default_rng(seed).integers(0, 2, (PLACES, dimensions), dtype=np.int8) * 2 - 1
        self.placed = [np.roll(letters, WINDOW - 1 - i, axis=1) for i in range(WINDOW)]
        self.table, self.dimensions = letter_places() if table is None else table, dimensions

    def windows(self, text: str | None) -> np.ndarray:
        """The numbers of the windows of a text, one for each occurrence."""
        if not text:
            return np.empty(0, np.uint32)
        at = self.table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
        at = np.concatenate([[0], at, [0]]).astype(np.uint32)
        keep = at != 0
        keep[1:] |= at[:-1] != 0
        at = at[keep]
        if len(at) < 2:
            return np.empty(0, np.uint32)
        at = np.concatenate([[0], at]).astype(np.uint32) if at[0] else at
        return (at[:-2] * PLACES + at[1:-1]) * PLACES + at[2:]

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct windows of a text and their weights."""
        found, n = np.unique(self.windows(text), return_counts=True)
        return found, np.sqrt(n)

    def bound(self, windows: np.ndarray) -> np.ndarray:
        out = self.placed[0][windows // PLACES**2]
        out = out * self.placed[1][windows // PLACES % PLACES]
        return out * self.placed[2][windows % PLACES]

    def bundles(self, counted: list[tuple[np.ndarray, np.ndarray]], step: int = 8192, kind: type = np.float32) -> np.ndarray:
        """One bundle for each (windows, counts)."""
        out = np.zeros((len(counted), self.dimensions), kind)
        known = np.unique(np.concatenate([w for w, _ in counted])) if counted else np.empty(0, np.uint32)
        places = [np.searchsorted(known, w) for w, _ in counted]
        for at in range(0, len(known), step):
            counts = np.zeros((len(counted), min(step, len(known) - at)), kind)
            for row, (p, (_, n)) in enumerate(zip(places, counted, strict=True)):
                a, b = np.searchsorted(p, [at, at + step])
                counts[row, p[a:b] - at] = n[a:b]
            out += counts @ self.bound(known[at : at + step]).astype(kind)
        return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """lang and text of documents that aren't held out, at most per_language of each language in expectation."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = staged(usable.groupBy(F.col("lang").alias("__lang")).agg(F.count("*").alias("__n")), "languages")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 20)) / (1 << 20)
    return usable.join(sizes, usable["lang"] == sizes["__lang"]).where(draw < per_language / F.col("__n")).select("lang", "text")


def prototypes(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """The languages that occur in documents not held out, sorted, and a unit vector for each."""
    table = docs.sparkSession.sparkContext.broadcast(letter_places())

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums = Space(table.value), {}
        for batch in batches:
            langs, texts = np.array(batch.column("lang").to_pylist(), object), batch.column("text").to_pylist()
            for lang in dict.fromkeys(langs.tolist()):
                found = [space.counted(texts[i]) for i in np.flatnonzero(langs == lang)]
                w, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                n = np.bincount(at, np.concatenate([np.rint(f[1] * GRAIN) for f in found]), len(w))
                if len(w):
                    sums[lang] = sums.get(lang, 0) + space.bundles([(w, n)], kind=np.float64)[0]
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v.astype(np.int64))], names=["lang", "place", "n"])

    added = sampled(docs, per_language).mapInArrow(bundle, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n"))
    rows = added.toPandas()  # DIMENSIONS numbers a language
    langs = sorted(rows["lang"].unique())
    made = np.zeros((len(langs), DIMENSIONS))
    number = {lang: i for i, lang in enumerate(langs)}
    made[rows["lang"].map(number).to_numpy(int), rows["place"].to_numpy(int)] = rows["n"].to_numpy(float)
    return langs, unit(made).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs, lang_pred and score for every whole text."""
    model = model or prototypes(docs)
    sent = docs.sparkSession.sparkContext.broadcast((*model, letter_places()))  # languages times DIMENSIONS floats, and a table of letters
    source = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keep] + ["lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, vectors, table = sent.value
        space = Space(table)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                counted = [space.counted(x) for x in part.column("__text").to_pylist()]
                names, scores = [UNKNOWN] * len(counted), [0.0] * len(counted)
                if langs:
                    near = unit(space.bundles(counted)) @ vectors.T
                    for i, (w, _) in enumerate(counted):
                        if len(w):
                            best = int(near[i].argmax())
                            names[i], scores[i] = langs[best], float(min(1.0, max(0.0, near[i, best])))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return source.mapInArrow(run, schema)
