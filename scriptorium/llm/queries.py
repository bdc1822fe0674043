"""Queries of the corpus operators over whole tables, and the SQL that some of them are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .common import held_out, read
from .html_text import extract
from .langid import identify
from .manifest import audited, siblings
from .maxscore import top_k
from .mixing import mix
from .packing import pack
from .quality_rules import quality_rules
from .resampling import resample
from .simhash import near_duplicates
from .site_quality import site_quality
from .sql import SQL
from .toxicity import score_documents, train
from .training_order import training_order


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"), keep=("doc_id", "source", "lang"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "sampled")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), want=("n_tokens", "ids_sha256", "decoded_sha256"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=("doc_id", "source", "lang"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), carry={"ids_crc32": F.crc32("ids")})


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audited(read(spark, sf_dir, "documents"))
    proof = F.sha2(siblings(F.col("lefts"), F.col("rights")).cast("binary"), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    f.__name__: f
    for f in (
        op1_training_order, op2_quality_rules, op3_toxicity, op4_maxscore, op5_mixing, op6_bpe, op7_simhash, op8_html_text, op9_site_quality, op10_language_id,
        op11_packing, op12_resampling, op13_manifest,
    )
}
