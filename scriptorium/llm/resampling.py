"""Target-distribution importance resampling with hashed word n-grams from a position table.

Words are taken from whole texts and exploded with their places; lead() over a document's places puts the following words
beside each, so that every place has its run of 1, 2, ... `orders` words, joined by one space. A run's UTF-8 bytes are hashed
to one of `buckets`, and that table of places is written. Buckets are counted over it and over the target's texts alike; a
bucket's gain is the floored thousandfold logarithm of how much more frequent it is, with one added to each count, in the target
than here. Gains are joined with the places and summed by document: a document's weight is the floored mean. A document's
score adds Gumbel noise that a digest of its id fixes, so that the highest scores are a sample without replacement by
weight.

Texts are shuffled once, as whole rows by file and row, before their words are exploded: the window needs no other shuffle.
Counts are added up before they are shuffled. Gains are broadcast: they are `buckets` rows, whatever the data. Ranks
are places in ranges of the order and what earlier ranges hold; no task sees the whole order.

Cases: a null text has no words; a document without words has weight 0; an empty target or an empty table of documents
gives gains of smoothed counts; repeated rows are counted and drawn each by itself; ties go to the smaller doc_id, null ones
last; a null doc_id is drawn with the digest of no id; very long texts are exploded whole; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scans import numbered_by
from .common import staged

ORDERS, BUCKETS, SCALE, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 1000, 20, 25, "7"
#: Fixed value: what separates words once A-Z are lower-cased.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """text with only A-Z lower-cased; a text of ASCII alone needs no table."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def by_row(rows: DataFrame) -> DataFrame:
    """rows with __file and __row, which together tell them apart and stay the same when a task runs again."""
    place = lambda df: df.select("*", F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    try:
        return place(rows)
    except AnalysisException:  # rows that come from no file
        return place(staged(rows, "rows"))


def position_table(texts: DataFrame, keep: tuple[str, ...] = (), orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """__file, __row, `keep` and b1, ..., b<orders> of each place: the buckets of the runs that begin there, null where none does. Every text has a row at least."""
    rows = by_row(texts.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))).repartition("__file", "__row")
    key = ["__file", "__row", *keep]
    # Separators at either end leave an empty word there, which no run goes over.
    words = rows.select(*key, F.posexplode(F.split(lowered(F.col("__text")), SEPARATORS)).alias("__at", "__word")).withColumn("__word", F.nullif("__word", F.lit("")))
    along = Window.partitionBy("__file", "__row").orderBy("__at")
    following = words.select(*key, F.col("__word").alias("__w0"), *[F.lead("__word", k).over(along).alias(f"__w{k}") for k in range(1, orders)])

    def bucket(n: int) -> Column:
        run = F.col("__w0")
        for k in range(1, n):
            run = F.concat(run, F.lit(" "), F.col(f"__w{k}"))
        return (F.crc32(run.cast("binary")) % buckets).cast("int").alias(f"b{n}")

    return staged(following.select(*key, *[bucket(n) for n in range(1, orders + 1)]), "positions")


def bucket_counts(places: DataFrame, orders: int, name: str) -> DataFrame:
    each = places.select(F.explode(F.array(*[f"b{n}" for n in range(1, orders + 1)])).alias("bucket"))
    return each.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))


def bucket_gains(places: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """bucket, here, there and gain of every bucket."""
    all_of = places.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = all_of.join(bucket_counts(places, orders, "here"), "bucket", "left").join(bucket_counts(target, orders, "there"), "bucket", "left").na.fill(0, ["here", "there"])
    counts = staged(counts, "counts")
    total = counts.agg(F.sum("here").alias("here"), F.sum("there").alias("there")).first()
    number = lambda c: c.cast("double")
    ratio = (number(F.col("there")) + 1) * float(total["here"] + buckets) / ((number(F.col("here")) + 1) * float(total["there"] + buckets))
    return staged(counts.select("bucket", "here", "there", F.floor(scale * F.log(ratio)).alias("gain")), "gains")


def weights(places: DataFrame, gains: DataFrame, keep: tuple[str, ...], orders: int = ORDERS) -> DataFrame:
    """__file, __row, `keep`, n_words, n_features and weight of each text."""
    known = places
    for n in range(1, orders + 1):
        own = gains.select(F.col("bucket").alias(f"__b{n}"), F.col("gain").alias(f"__g{n}"))
        known = known.join(F.broadcast(own), F.col(f"b{n}") == F.col(f"__b{n}"), "left")  # as many rows as there are buckets
    add = lambda columns: reduce(lambda a, b: a + b, columns)
    gained = add([F.coalesce(f"__g{n}", F.lit(0)) for n in range(1, orders + 1)])
    told = add([F.col(f"b{n}").isNotNull().cast("long") for n in range(1, orders + 1)])
    summed = known.groupBy("__file", "__row", *keep).agg(F.sum(gained).alias("__gain"), F.sum(told).alias("n_features"), F.count("b1").alias("n_words"))
    weight = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.floor(F.col("__gain") / F.col("n_features"))).cast("long")
    return summed.select("__file", "__row", *keep, "n_words", "n_features", weight.alias("weight"))


def noise(doc_id: Column, seed: str = SEED, scale: int = SCALE) -> Column:
    """A standard Gumbel variable, scaled and floored, fixed by the seed and the id."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-scale * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, `keep`, n_words, n_features, weight, score and rank of every document; rank is null for what isn't drawn.

    Drawn are `percent` percent, floored, of the documents with least_words words or more. target has a column text.
    """
    held = ("doc_id", *keep)
    places = position_table(docs, held, orders, buckets)
    gains = bucket_gains(places, position_table(target, (), orders, buckets), orders, buckets)
    judged = staged(weights(places, gains, held, orders).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    entitled = F.col("n_words") >= least_words
    drawn = judged.where(entitled).count() * percent // 100
    ranked = numbered_by(judged.where(entitled), F.desc("score"), F.asc_nulls_last("doc_id"), "__file", "__row", name="__place")
    rank = F.when(F.col("__place") < drawn, F.col("__place") + 1)
    out = [*held, "n_words", "n_features", "weight", "score"]
    return ranked.select(*out, rank.alias("rank")).unionByName(judged.where(~entitled).select(*out, F.lit(None).cast("long").alias("rank")))
