"""op5: what is kept against the targets, topics against a plain reading, both ways to rake."""

import math
import re

import numpy as np
import pytest

from scriptorium.llm import mixing as X
from scriptorium.llm.common import staged

MARGINS = (X.Margin("source", power=0.5), X.Margin("lang", {"l0": 0.5, "l1": 0.3}, power=0.5), X.Margin("topic", power=0.9))


def cells(spark, seed=1, hot=0):
    rng = np.random.default_rng(seed)
    rows = [(f"s{a}", [None, "l0", "l1", "l2"][b], f"t{c}", int(rng.integers(1, 5000)) + hot * (a == 0)) for a in range(6) for b in range(4) for c in range(3)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def shares(raked, column):
    kept = raked.probability * raked.tokens
    return (kept.groupby(raked[column].fillna("null")).sum() / kept.sum()).to_dict()


@pytest.mark.parametrize("hot", [0, 30_000])
def test_what_is_kept_meets_every_target_that_can_be_met(spark, hot):
    table = cells(spark, hot=hot)
    raked = X.rake(table, MARGINS, near=1e-5, rounds=400)
    told = raked.toPandas()
    assert told.probability.between(0, 1).all()
    assert abs((told.probability * told.tokens).sum() / told.tokens.sum() - X.FRACTION) < 1e-3
    for r in X.margins_met(table, raked, MARGINS).collect():
        assert abs(r["expected"] / r["reachable"] - 1) < 1e-3, r
        assert r["reachable"] <= r["target"] * 1.5
    lang = shares(told, "lang")
    others = sum(v for k, v in lang.items() if k in ("null", "l2"))
    tokens = told.tokens.groupby(told.lang.fillna("null")).sum() / told.tokens.sum()
    own = {k: v**0.5 for k, v in tokens.items()}
    assert abs(others - (own["null"] + own["l2"]) / sum(own.values())) < 0.01  # unlisted and null languages have targets of their own


def test_raking_stops_when_it_has_settled(spark, monkeypatch):
    written = []
    monkeypatch.setattr(X, "staged", lambda df, label: written.append(label) or staged(df, label))
    X.rake(cells(spark), MARGINS, near=1e-3)
    few = written.count("raked")
    written.clear()
    X.rake(cells(spark), MARGINS, near=1e-9, rounds=400)
    assert few < written.count("raked") < 100


def test_both_ways_to_rake(spark):
    key = ["source", "lang", "topic"]
    one, other = (X.rake(cells(spark), MARGINS, rounds=8, few=few).toPandas().fillna("null").sort_values(key).reset_index(drop=True) for few in (10**6, 0))
    assert np.allclose(one.weight, other.weight, rtol=1e-12) and (one[key] == other[key]).all().all()


def test_levels_smaller_than_their_target(spark):
    rows = [("big", "l0", "t", 10_000), ("small", "l1", "t", 100)]
    table = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    told = {r["source"]: r for r in X.rake(table, (X.Margin("source", {"big": 0.5, "small": 0.5}),), near=1e-6).collect()}
    assert abs(told["small"]["probability"] - 1) < 1e-9
    met = {r["level"]: r for r in X.margins_met(table, X.rake(table, (X.Margin("source", {"big": 0.5, "small": 0.5}),)), (X.Margin("source", {"big": 0.5, "small": 0.5}),)).collect()}
    assert met["small"]["target"] == 0.5 and met["small"]["reachable"] < 0.02 and abs(met["big"]["expected"] - met["big"]["reachable"]) < 1e-3


def plain_scales(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = max(1, len(words))
    count = lambda marks: sum(c in marks for c in text or "")
    symbols = "#*$%&|<>{}[]()^~_\\=+@!?;:/\""
    tens = [count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count("0123456789"), count(symbols), count("\n")]
    return [min(9, math.floor(math.log(1 + len(words)))), min(9, sum(map(len, words)) // n), *[min(9, 10 * x // n) for x in tens]]


def plain_topics(texts, topics=X.TOPICS):
    points = [np.array(plain_scales(t)) for t in texts if re.search(r"[^\x20\x09-\x0D]", t or "")]
    groups = {0: points}
    rules = []
    for made in range(1, topics):
        spread = {(g, j): sum((p[j] - np.mean([q[j] for q in ps])) ** 2 for p in ps) for g, ps in groups.items() if ps for j in range(6)}
        most = max(spread.values())
        if most <= 1e-9:
            break
        g, j = min(k for k, v in spread.items() if v >= most - 1e-9)
        mean = np.mean([q[j] for q in groups[g]])
        rules.append((g, j, mean, made))
        groups[made] = [p for p in groups[g] if p[j] > mean]
        groups[g] = [p for p in groups[g] if p[j] <= mean]

    def topic(text):
        if not re.search(r"[^\x20\x09-\x0D]", text or ""):
            return "empty"
        point, group = plain_scales(text), 0
        for g, j, mean, made in rules:
            if group == g and point[j] > mean:
                group = made
        return f"topic {group}"

    return topic


def test_topics_are_learned_from_texts(spark):
    rng = np.random.default_rng(3)
    kinds = [lambda: " ".join(rng.choice(["river", "stone", "Letter"], 40)), lambda: "\n".join(f"{a} | {b}" for a, b in rng.integers(0, 99, (9, 2))), lambda: "f(x) = [y]; // " * 9, lambda: "SHOUTING " * int(rng.integers(2, 200))]
    texts = [kinds[i % 4]() for i in range(200)] + [None, "", " \n", "é", "word " * 50_000]
    df = spark.createDataFrame([(i, t, "en", "s", "clash", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, topic string, __scales string")
    got = {r["doc_id"]: r for r in X.mix(df).collect()}
    topic = plain_topics(texts)
    assert [got[i]["topic"] for i in range(len(texts))] == [topic(t) for t in texts]
    assert len({got[i]["topic"] for i in range(4)}) >= 3
    assert [got[i]["tokens"] for i in range(len(texts))] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_mix(spark):
    rows = [(i, "word " * (10 + i % 50), ["en", "fr", None][i % 3], "hot" if i % 2 else None, "clash") for i in range(600)]
    rows += [(700, None, "en", "hot", "c"), (None, "x y", "de", "s", "c"), (1, rows[1][1], "fr", "hot", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens string")
    got = X.mix(df).collect()
    assert len(got) == len(rows)
    assert all(r["sampled"] and r["topic"] == "empty" for r in got if r["doc_id"] == 700)
    again = X.mix(df).collect()
    assert sorted((str(r["doc_id"]), r["sampled"]) for r in got) == sorted((str(r["doc_id"]), r["sampled"]) for r in again)
    kept = sum(r["tokens"] for r in got if r["sampled"]) / sum(r["tokens"] for r in got)
    assert 0.6 < kept < 0.8
    assert X.mix(df.limit(0)).count() == 0
