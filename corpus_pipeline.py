"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Language identification, quality, near-duplicates, mixing and tokens, in this order. Every stage works on
all rows that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.bpe import encode_documents
from scriptorium.llm.common import DOCUMENT_COLUMNS, Scope, read, staged
from scriptorium.llm.langid import UNKNOWN, identify
from scriptorium.llm.mixing import mix
from scriptorium.llm.near_copies import near_copies
from scriptorium.llm.site_quality import site_quality
from scriptorium.llm.training_order import numbered


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its other columns under names that no operator uses, and their own names."""
    names = {f"__other{i}": c for i, c in enumerate(docs.columns) if c not in DOCUMENT_COLUMNS}
    return docs.withColumnsRenamed({c: k for k, c in names.items()}), names


def again(rows: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of docs, in their order and under their own names."""
    held = {c: k for k, c in names.items()}
    return rows.select(*[F.col(held.get(c, c)).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    own, names = apart(docs)
    told = identify(own, keep=tuple(own.columns))
    return again(told.where(F.col("lang_pred") != UNKNOWN), docs, names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is high enough."""
    own, names = apart(docs)
    judged = site_quality(own, read(spark, sf_dir, "labels"), keep=tuple(own.columns))
    return again(judged.where("kept"), docs, names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Near copies are texts whose five-word shingles have a Jaccard similarity of 0.8 or more: what SimHash finds, verified, and the rest by
    `near_copies`. Every row takes part by itself, with or without a doc_id and whether or not others share it. A group keeps a row with a doc_id if
    it has one; among rows that share it a hash of text and columns decides, and rows that are alike in all are one.
    """
    own, names = apart(docs)
    rows, _ = numbered(own)
    groups = near_copies(rows.select(F.col("number").alias("doc_id"), "text")).select(F.col("doc_id").alias("__member"), F.col("component_id").alias("__group"))
    told = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in own.columns])
    order = F.struct(F.col("doc_id").isNull().alias("null_last"), F.col("doc_id").alias("id"), told.alias("told"), F.col("number").alias("number"))
    first = rows.select("number", order.alias("o")).join(groups, F.col("number") == F.col("__member")).groupBy("__group").agg(F.min("o").alias("o")).select(F.col("o.number").alias("__first"))
    return again(rows.join(first, rows["number"] == first["__first"], "left_semi"), docs, names)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come near their target shares of tokens."""
    own, names = apart(docs)
    return again(mix(own).where("sampled"), docs, names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, their number, and digests of the ids and of what they decode to."""
    return encode_documents(docs, want=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("language identification", language),
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("mixing to target weights", mixing),
    ("byte-level BPE", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage has written on its way, and what it has read, goes when its result stands."""
    docs, behind = read(spark, sf_dir, "documents"), Scope(spark)
    for name, stage in STAGES[:-1]:
        with Scope(spark) as own:
            result = stage(spark, docs, sf_dir)
        with Scope(spark) as kept:
            docs = staged(result, name.split()[0])
        own.release()
        behind.release()
        behind = kept
    return STAGES[-1][1](spark, docs, sf_dir)
