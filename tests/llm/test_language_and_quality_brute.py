"""op9 and op10 against plain second implementations over whole small tables."""

import math
import os
import re
from collections import defaultdict

import numpy as np
import pytest

from scriptorium.llm import langid as L
from scriptorium.llm import site_quality as S
from scriptorium.llm.common import is_held_out

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")


def plain_bundle(text, letters, table):
    """A text's vector: the product of its letters' vectors, rolled by their places, for each window; each distinct window counts the root of its number."""
    gaps = "".join(c if c.isalpha() else "\0" for c in (text or "").lower())
    gaps = re.sub("\0+", "\0", f"\0{gaps}\0")
    if gaps == "\0":
        return None
    n = defaultdict(int)
    for i in range(len(gaps) - 2):
        n[gaps[i : i + 3]] += 1
    out = np.zeros(letters.shape[1])
    for window, times in n.items():
        vector = np.ones(letters.shape[1])
        for place, c in enumerate(window):
            vector = vector * np.roll(letters[table[ord(c)] if c != "\0" else 0], 2 - place)
        out += vector * math.sqrt(times)
    return out


def plain_languages(rows):
    letters, table = np.random.default_rng(L.SEED).integers(0, 2, (L.PLACES, L.DIMENSIONS), dtype=np.int8) * 2.0 - 1, L.letter_places()
    vectors = [plain_bundle(t, letters, table) for _, t, _ in rows]
    sums = defaultdict(lambda: np.zeros(L.DIMENSIONS))
    for (i, _, lang), v in zip(rows, vectors, strict=True):
        if lang is not None and v is not None and not (i is not None and is_held_out(i)):
            sums[lang] += v
    names = sorted(sums)
    out = []
    for (i, _, _), v in zip(rows, vectors, strict=True):
        near = [] if v is None else [v @ sums[k] / np.linalg.norm(v) / np.linalg.norm(sums[k]) for k in names]
        out.append((i, near, names))
    return out


@needs_tables
def test_language_query_equals_the_plain_reading(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    rows += [(None, "the and of", None), (7000, None, "en"), (7001, "12 .", "fr"), (7002, "ça " * 60_000, "fr"), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit("clash"))
    got = defaultdict(list)
    for r in L.identify(df).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    for i, near, names in plain_languages(rows):
        for lang, score in got[i]:
            if not near:
                assert (lang, score) == ("und", 0.0)
            else:
                assert abs(score - max(0, max(near))) < 1e-5 and max(near) - near[names.index(lang)] < 1e-5
    assert sum(map(len, got.values())) == len(rows)


def test_equal_languages_tie_to_the_first(spark):
    df = spark.createDataFrame([(i, "bala balu lubab", ["zz", "aa"][i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.identify(df.where("doc_id <= 3 or doc_id > 3")).collect()} <= {"aa", "zz"}
    even = spark.createDataFrame([(i, "bala balu", k) for i, k in ((1, "zz"), (2, "aa")) if not is_held_out(i)] + [(90, "bala balu", None)], "doc_id long, text string, lang string")
    told = L.identify(even).collect()
    assert len({r["lang_pred"] for r in told}) == 1 and all(r["lang_pred"] == min(k for k in ("aa", "zz")) for r in told if len({1, 2} - {i for i in (1, 2) if is_held_out(i)}) == 2)


def plain_evidence(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return None
    size = lambda s: len(s.encode())
    of = lambda pattern: len(re.findall(pattern, text))
    chars, n = sum(map(size, words)), len(words)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    stops = {w for v in S.STOP_WORDS.values() for w in v}
    return [1, math.log(n), min(20, chars / n) / 5, of("[A-Z]") / chars, of("[0-9]") / chars, min(3, of(r"[#*$%&|<>{}\[\]^~_\\=+]") / n), min(3, of("[!?;:]") / n), sum(w in stops for w in words) / n, len(set(words)) / n, 1 - len(set(lines)) / len(lines)]


def logit(p):
    return math.log(p / (1 - p))


def plain_quality(rows, labels):
    """p of each row by Newton's method from nothing, the groups' shrunk means in plain loops, and the posterior."""
    known = {i: int(q > 0) for i, q in labels if i is not None and q is not None and not is_held_out(i)}
    found = [plain_evidence(t) for _, t, _, _ in rows]
    train = [(f, known[i]) for (i, *_), f in zip(rows, found, strict=True) if i in known and f is not None]
    x, y = np.array([f for f, _ in train], float), np.array([v for _, v in train], float)
    center, scale = x.mean(0), x.std(0)
    center[0], scale[0] = 0, 1
    scale[scale < 1e-9] = 1
    z, w = (x - center) / scale, np.zeros(10)
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(y) + 1e-3 * np.eye(10), z.T @ (p - y) / len(y) + 1e-3 * w)
    own = [None if f is None else 1 / (1 + math.exp(-max(-12, min(12, float((np.array(f) - center) / scale @ w))))) for f in found]
    paths, sites = defaultdict(list), defaultdict(list)
    for (_, _, lang, source), p in zip(rows, own, strict=True):
        if p is not None:
            paths[source, lang].append(p)
            sites[source].append(p)
    every = [p for p in own if p is not None]
    overall = min(1 - 1e-6, max(1e-6, sum(every) / len(every)))

    def strength(groups, mean):
        if len(groups) < 2:
            return 1000.0
        n = sum(len(g) for g in groups.values())
        within = sum(len(g) * mean[k] * (1 - mean[k]) for k, g in groups.items()) / n
        spread = sum(len(g) * (sum(g) / len(g) - mean[k]) ** 2 for k, g in groups.items())
        between = (spread - len(groups) * within) / max(1e-9, n - sum(len(g) ** 2 for g in groups.values()) / n)
        return min(1e6, max(2.0, within / between - 1)) if between > 1e-12 else 1e6

    a = strength(sites, dict.fromkeys(sites, overall))
    site_mean = {k: (sum(g) + a * overall) / (len(g) + a) for k, g in sites.items()}
    b = strength(paths, {k: site_mean[k[0]] for k in paths})
    path_mean = {k: (sum(g) + b * site_mean[k[0]]) / (len(g) + b) for k, g in paths.items()}
    out = []
    for (i, _, lang, source), p in zip(rows, own, strict=True):
        if p is None:
            out.append((i, 0.0, None, None, 0.0))
        else:
            lift = logit(min(1 - 1e-6, max(1e-6, path_mean[source, lang]))) - logit(overall)
            odds = logit(min(1 - 1e-6, max(1e-6, p))) + S.GROUP_WEIGHT * lift
            out.append((i, p, site_mean[source], path_mean[source, lang], 1 / (1 + math.exp(-odds))))
    return out


@needs_tables
def test_quality_query_equals_the_plain_reading(spark):
    from pyspark.sql import functions as F

    docs = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    docs += [(None, docs[1][1], None, None), (7000, None, "en", "src0"), (7001, " \n", "en", "src0"), (7002, "the long way of it " * 50_000, None, "src1"), (7003, docs[3][1], docs[3][2], docs[3][3])]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    df = df.withColumns({c: F.lit("clash") for c in ("p", "site", "path", "k", "n", "lift", "good", "posterior", "kept", "__whole")})
    got = {r["doc_id"]: r for r in S.site_quality(df, spark.createDataFrame([*labels, (None, 1)], "doc_id long, quality int")).collect()}
    assert len(got) == len(docs)
    for i, p, site, path, posterior in plain_quality(docs, labels):
        r = got[i]
        assert abs(r["document_score"] - p) < 1e-6 and abs(r["posterior"] - posterior) < 1e-6
        assert r["kept"] == (posterior >= S.LEAST_POSTERIOR) or abs(posterior - S.LEAST_POSTERIOR) < 1e-6
        if site is not None:
            assert abs(r["site_mean"] - site) < 1e-6 and abs(r["path_mean"] - path) < 1e-6
    assert got[7003]["posterior"] == got[docs[3][0]]["posterior"]  # repeated texts tie
