import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from scriptorium.llm import resampling as R
from scriptorium.llm.queries import op12_resampling
from scriptorium.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"


def brute(docs, target, orders=2, buckets=10_000, least=20, percent=25):
    def runs(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(words) - n + 1)]

    own = [runs(t) for _, t in docs]
    here, there = Counter(b for _, f in own for b in f), Counter(b for t in target for b in runs(t)[1])
    s, t = sum(here.values()), sum(there.values())
    gain = [math.floor(1000 * math.log((there[b] + 1.0) * (s + buckets) / ((here[b] + 1.0) * (t + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, _), (n, features) in zip(docs, own, strict=True):
        weight = math.floor(sum(gain[b] for b in features) / len(features)) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    entitled = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for place, r in enumerate(entitled[: len(entitled) * percent // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in out)


def made():
    rng = np.random.default_rng(5)
    words = ["stone", "River", "ÉTÉ", "été", "x1", "a_b", "don't", "日本", "Zz"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 60, 160)]
    texts += [None, "", " ", "one", ",lead and trail,", "Kelvin K sign İ", "w " * 30_000, "same words " * 15, "same words " * 15]
    docs = [(i, t) for i, t in enumerate(texts)]
    return [*docs, docs[0], docs[5], (None, texts[7]), (None, None), (5, "another text with id five")], ["stone river été", "x1 x1 x1", None, ""]


def answers(rows):
    return Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows)


def test_against_brute_force(spark):
    docs, target = made()
    df = spark.createDataFrame([(i, t, "clash", 0) for i, t in docs], "doc_id long, text string, n_words string, bucket int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert answers(R.resample(df, aim).collect()) == brute(docs, target)
    assert answers(R.resample(df, aim, orders=3, buckets=50, percent=60, least_words=1).collect()) == brute(docs, target, 3, 50, 1, 60)
    assert answers(R.resample(df, aim.limit(0)).collect()) == brute(docs, [])
    assert R.resample(df.limit(0), aim).count() == 0


def test_ranks_are_places_without_gaps(spark):
    docs = [(i, "the same twenty words " * 6) for i in range(300)]
    found = R.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame([("the words",)], "text string")).collect()
    drawn = sorted((r["rank"], -r["score"], r["doc_id"]) for r in found if r["rank"])
    assert [r[0] for r in drawn] == list(range(1, 76))
    assert [r[1:] for r in drawn] == sorted(r[1:] for r in drawn)


def test_query_is_what_sql_says(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    answer = con.execute(SQL["op12_resampling"])
    names = [c[0] for c in answer.description]
    rows = op12_resampling(spark, FOLDER)
    assert sorted(rows.columns) == sorted(names)
    assert answers(rows.collect()) == Counter(tuple(r[names.index(c)] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in answer.fetchall())
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert answers(rows.collect()) == brute(docs, [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
