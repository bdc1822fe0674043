import hashlib

import pytest
import tiktoken
from pyspark.sql import functions as F

from scriptorium.llm import training_order as O
from scriptorium.llm.bpe import default_vocabulary, ranks_of, read_ranks


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(read_ranks(default_vocabulary())), special_tokens={})


def told(library, text):
    return hashlib.sha256(b"".join(int(t).to_bytes(2, "little") for t in library.encode_ordinary(text))).hexdigest()


def test_folders_that_look_like_parts(spark, tmp_path, library):
    texts = [f"text {i} " * (i % 40) for i in range(120)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    path = str(tmp_path / "out.c7.x" / "b.c001.y")
    found = O.training_order(spark.read.parquet(str(tmp_path / "docs")), path, record=16, slots=50, part=4).collect()
    assert {r["doc_id"]: r["tokens_sha256"] for r in found} == {i: told(library, t) for i, t in enumerate(texts)}
    every = O.records(spark, path, record=16, part=4).select("shard", "number").collect()
    assert len({(r["shard"], r["number"]) for r in every}) == len(every)
    for shard in {r["shard"] for r in every}:
        own = sorted(r["number"] for r in every if r["shard"] == shard)
        assert own == list(range(len(own)))
    later = O.records(spark, path, shard=1, first=6, record=16, part=4).select("shard", "number").collect()
    assert sorted(later) == sorted(r for r in every if r["shard"] > 1 or r["shard"] == 1 and r["number"] >= 6)


@pytest.mark.parametrize("sent", [0, 10])
def test_numbers_are_dense_either_way(spark, tmp_path, sent):
    spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(5).write.parquet(str(tmp_path / "docs"))
    rows, n = O.numbered(spark.read.parquet(str(tmp_path / "docs")), sent_files=sent)
    assert n == 200
    assert sorted(r["number"] for r in rows.collect()) == list(range(200))


def test_no_text_is_shuffled(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(5).write.parquet(str(tmp_path / "docs"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = O.numbered(spark.read.parquet(str(tmp_path / "docs")))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


def test_very_long_texts(spark, library):
    texts = ["stone river " * 60_000, " " * 200_000 + "x", "=" * 100_000, "\n" * 60_000]
    found = {r["doc_id"]: r for r in O.training_order(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), record=512, slots=2, part=64).collect()}
    for i in (0, 2):
        assert found[i]["tokens_sha256"] == told(library, texts[i])
    assert found[1]["n_tokens"] == 200_000
