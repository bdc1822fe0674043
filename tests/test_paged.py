import json

import pytest

from scriptorium.sources.paged import register_pages


def log_of(path):
    return [json.loads(x) for x in path.read_text().splitlines()] if path.exists() else []


def test_offsets_are_partitions(spark, tmp_path):
    def fetch(url, params):
        first, n = params["startRecord"], params["maximumRecords"]
        return 200, json.dumps({"total": 23, "records": list(range(first, min(24, first + n))), "query": params["query"]})

    register_pages(spark, "listing", fetch, "http://x", {"query": "q"}, total=lambda body: json.loads(body)["total"], page=5)
    pages = spark.read.format("listing").load()
    assert pages.rdd.getNumPartitions() == 5
    found = {r["offset"]: json.loads(r["body"])["records"] for r in pages.collect()}
    assert [x for o in sorted(found) for x in found[o]] == list(range(1, 24))
    register_pages(spark, "nothing", lambda u, p: (200, '{"total": 0}'), "http://x", total=lambda body: json.loads(body)["total"])
    assert spark.read.format("nothing").load().count() == 1


def test_a_read_that_was_broken_off_goes_on_at_its_token(spark, tmp_path):
    asked, broken = tmp_path / "asked", tmp_path / "broken"
    broken.write_text("")

    def fetch(url, params):
        at = params.get("at", 0)
        with asked.open("a") as file:
            file.write(json.dumps(at) + "\n")
        if at == 3 and broken.exists():
            raise OSError("connection lost")
        return 200, json.dumps({"items": [{"n": at * 10 + k} for k in range(2)], "next": at + 1 if at < 5 else None})

    register_pages(spark, "tokens", fetch, "http://x", token=lambda x: None if x["next"] is None else {"at": x["next"]}, items=lambda x: x["items"], tries=1)

    def run():
        query = spark.readStream.format("tokens").load().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).start(str(tmp_path / "out"))
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="(?s).*"):
        run()
    assert 3 in log_of(asked) and 4 not in log_of(asked)
    broken.unlink()
    asked.unlink()
    run()
    assert min(log_of(asked)) >= 2  # the page before may be replayed, what was written before it isn't
    rows = [json.loads(r["item"])["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(rows) == [at * 10 + k for at in range(6) for k in range(2)]
