import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import quality_rules as Q
from scriptorium.llm import site_quality as S


def brute(text):
    words = [w for w in (text or "").translate({ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    n = len(words)
    windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    texts = [None, "", " \n ", "one", "a b c a b c", "a b c d a b c", "x x x x x", "l1 w\nl1 w\n\nl1 w \n", "é# *$%&|<> b", " lead trail ", "w " * 300, "a b c " * 200 + "z", " ".join(f"w{i % 70}" for i in range(400))]
    rng = np.random.default_rng(2)
    texts += [" ".join(rng.choice(list("abcd"), rng.integers(1, 60))) for _ in range(30)]
    texts += [" ".join(rng.choice([f"t{i}" for i in range(6)], 3000))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in Q.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, rep = brute(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep), (t or "")[:40]
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert Q.quality_rules(df.limit(0)).count() == 0


def test_both_ways_of_finding_positions_agree(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(" ".join(rng.choice(list("abc"), 80)),) for _ in range(20)], "text string").select(F.split("text", " ").alias("w"))
    rows = df.select(Q.repeated_window_words(F.col("w"), few=0).alias("a"), Q.repeated_window_words(F.col("w"), few=1000).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=300))
def test_evidence_is_finite(text):
    found = S.evidence(text)
    assert found is None or np.isfinite(found).all()


def corpus():
    rng = np.random.default_rng(7)
    good = lambda: " ".join(rng.choice("the of and to was in river stone garden letter morning window paper".split(), 80))
    bad = lambda: " ".join(w + "***" for w in rng.choice("THE RIVER STONE XX YY".split(), 80))
    rows = [(i, bad() if i % 4 == 0 else good(), ["en", None][i % 2], f"s{i % 5}" if i % 7 else None) for i in range(240)]
    return rows, [(i, int(i % 4 != 0)) for i in range(240) if i % 3]


def test_site_quality(spark):
    rows, labels = corpus()
    extra = [(900, None, "en", "s1"), (901, "", "en", None), (None, rows[1][1], "en", "s2"), (1, rows[1][1], "en", "s1")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, source string")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, quality int")
    got = S.site_quality(docs, marks, keep=("doc_id", "source")).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 900:
            assert r["kept"] == (r["doc_id"] % 4 != 0)
        elif r["doc_id"] is not None:
            assert not r["kept"] and r["posterior"] == 0.0
    assert all(0 <= r["posterior"] <= 1 for r in got)


def test_without_labels_or_documents(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows[:10], "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert S.site_quality(docs, none).where("kept").count() == 10
    assert S.site_quality(docs.limit(0), none).count() == 0


def test_sparse_groups_shrink(spark):
    cells = [("a", "x", 0.9)] * 200 + [("b", "x", 0.1)] * 200 + [("c", "x", 0.1)] * 2
    told = {r["site"]: r for r in S.posteriors(spark.createDataFrame(cells, "s string, t string, p double"), "s", "t").collect()}
    assert told["a"]["site_mean"] > 0.85 and told["b"]["site_mean"] < 0.15
    assert told["b"]["site_mean"] < told["c"]["site_mean"] < 0.5
