import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import manifest as M
from scriptorium.llm.queries import op13_manifest
from scriptorium.llm.sql import SQL

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    told = [None if v is None else str(v) for v in row]
    return digest(*["-" if v is None else f"{len(v.encode())}:{v}" for v in told])


def levels_of(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def climb(at, value, levels, fanout):
    """The digests beside a node at each level, and what a value in its place makes of the root."""
    proof = ""
    for level in levels[:-1]:
        first = at // fanout * fanout
        before, after = "".join(level[first:at]), "".join(level[at + 1 : first + fanout])
        proof, value, at = proof + before + after, digest(before, value, after), at // fanout
    return proof, value


def brute(rows, fanout=2):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for k in order:
        trees[k].sort(key=lambda x: x[:3])
        built[k] = levels_of([x[2] for x in trees[k]], fanout)
    top = levels_of([built[k][-1][0] for k in order], fanout)
    root, out = top[-1][0] if top[-1] else None, Counter()
    for t, k in enumerate(order):
        for i, (_, _, own, r) in enumerate(trees[k]):
            tried = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                tried = leaf((*r[:3], r[3] + 1, r[4]))
            lower, value = climb(i, tried, built[k], fanout)
            upper, value = climb(t, value, top, fanout)
            out[r[0], own, built[k][-1][0], root, digest(lower + upper), value, value == root] += 1
    return out


def answers(df):
    proof = F.sha2(M.siblings(F.col("lefts"), F.col("rights")).cast("binary"), 256)
    return Counter(tuple(r) for r in df.withColumn("proof", proof).select(COLUMNS).collect())


def made():
    rows = [(i, f"s{i % 3}", ["en", "fr", None, "é", "z"][min(i % 7, 4)], i if i % 5 else None, f"text {i} é") for i in range(300)]
    rows += [(900, "s", "only", 3, "a lone leaf"), (901, None, "", 0, ""), (902, "s", "", 0, None), (None, "s", "en", 1, "no id"), (None, "s", "en", None, "no id"), rows[3], rows[3], (3, "s", rows[3][2], 9, "same id"), (905, "s", "fr", 2**63 - 1, "long " * 50_000)]
    return rows


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 1), (2, 3), (3, 2), (16, 1)])
def test_against_brute_force(spark, fanout, levels):
    rows = made()
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, index int").repartition(4)
    assert answers(M.audited(df, fanout, levels)) == brute(rows, fanout)


def test_empty_and_single(spark):
    shape = "doc_id long, source string, lang string, n_chars long, text string"
    assert M.audited(spark.createDataFrame([], shape)).count() == 0
    one = [(7, None, None, None, None)]
    found = M.audited(spark.createDataFrame(one, shape))
    assert answers(found) == brute(one)
    assert found.first()["leaf"] == found.first()["root"]


def test_a_changed_column_is_told(spark):
    rows = made()[:50]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = M.audited(df).collect()
    for r in found:
        told = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["doc_id"] % 5 != 0
        assert r["verified"] != told
    assert any(not r["verified"] for r in found)


def test_query_is_what_sql_says(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    answer = con.execute(SQL["op13_manifest"])
    names = [c[0] for c in answer.description]
    rows = op13_manifest(spark, FOLDER)
    assert sorted(rows.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in rows.collect()) == Counter(answer.fetchall())
    docs = [tuple(r[c] for c in M.COLUMNS) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    assert Counter(tuple(r[c.replace("proof", "proof_sha256")] for c in COLUMNS) for r in rows.collect()) == brute(docs)
