import re

import numpy as np

from scriptorium.llm import langid as L
from scriptorium.llm import toxicity as X
from scriptorium.llm.common import is_held_out


def texts(seed=11, n=400):
    rng = np.random.default_rng(seed)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        toxic = i % 4 == 0
        if toxic:
            words[5] = str(rng.choice(["vilewordone", "nastyterm", "hatefulbit"]))
        if i % 8 == 0 or i % 11 == 0:  # mentions go with toxic texts more often than not
            words[6] = "muslim"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = texts()
    docs = spark.createDataFrame(rows + [(None, "nastyterm here"), (5000, None), (5001, ""), (5002, "A muslim neighbour"), (5003, "so nastyterm")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = X.train(docs, marks)
    got = {r["doc_id"]: r for r in X.score_documents(docs, model).collect()}
    held = [i for i, _ in rows if is_held_out(i)]
    assert held and np.mean([got[i]["predicted"] == int(i % 4 == 0) for i in held]) > 0.97
    assert got[5002]["predicted"] == 0 and got[5003]["predicted"] == 1 and got[5000]["score"] == got[5001]["score"] < 0.5
    assert len(got) == len(rows) + 5


def plain_features(text):
    """Words of letters only, in lower case, and their first four and five letters unless these begin a group's name."""
    found = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    names = {t for family in X.IDENTITY for t in family}
    begins = {t[:4] for t in names if len(t) >= 4} | {t[:5] for t in names if len(t) >= 5}
    return found | {w[:k] + "-" for w in found for k in (4, 5) if len(w) > k and w[:k] not in begins}


def plain_rewrites(text):
    """Every text in which one mention is another term of its family, or gone: made from the text itself."""
    out = []
    for family in X.IDENTITY:
        for t in family:
            if re.search(rf"(?<![^\W\d_]){t}(?![^\W\d_])", text.lower()):
                out += [re.sub(rf"(?<![^\W\d_]){t}(?![^\W\d_])", u, text.lower()) for u in [*family, ""] if u != t]
    return out


def test_rewritten_texts():
    for text in ("A Muslim neighbour and a jewish friend", "muslim jewish", "old men", "no one", "Muslims' women"):
        told = sorted(map(sorted, map(X.features, X.swapped(X.words(text)))))
        assert told == sorted(sorted(plain_features(t)) for t in plain_rewrites(text)), text


def objective(weights, bias, rows, y, cf, sparse):
    """The loss from the texts, with rewritten texts scored as texts."""
    share = y.mean()
    balance = np.where(y > 0, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    z = np.array([bias + sum(weights.get(f, 0.0) for f in plain_features(t)) for t in rows])
    loss = (balance * (np.logaddexp(0, z) - y * z)).sum() / balance.sum()
    with_mentions = [(t, r) for t in rows if (r := plain_rewrites(t))]
    score = lambda t: sum(weights.get(f, 0.0) for f in plain_features(t))
    moved = sum(np.mean([(score(x) - score(t)) ** 2 for x in r]) for t, r in with_mentions) / max(1, len(with_mentions))
    return loss + sparse * sum(map(abs, weights.values())) + cf * moved


def test_fit_is_the_least_of_the_plain_loss(spark):
    rows, labels = texts(n=160)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, toxic string, __toxic int")
    sparse, cf = 4e-3, 1.0
    strict = sparse * np.sqrt(12000 / sum(not is_held_out(i) for i, _ in rows))
    model = X.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), sparse=sparse, counterfactual=cf)
    learned = [(t, v) for (i, t), (_, v) in zip(rows, labels, strict=True) if not is_held_out(i)]
    told, y = [t for t, _ in learned], np.array([float(v) for _, v in learned])
    best = objective(model.weights, model.bias, told, y, cf, strict)
    for f in sorted({f for t in told for f in plain_features(t)} | set(model.weights))[::7] + ["muslim", "jewish"]:
        for step in (-0.02, 0.02):
            assert objective(model.weights | {f: model.weights.get(f, 0.0) + step}, model.bias, told, y, cf, strict) > best - 2e-5, f
    for text in ("so nastyterm", rows[0][1], rows[1][1], "", None):
        z = model.bias + sum(model.weights.get(f, 0.0) for f in plain_features(text))
        assert abs(model.score(text) - 1 / (1 + np.exp(-z))) < 1e-9


def test_neutral_mentions_in_texts_held_out(spark):
    """Mentions go with toxic labels in what is learned from; in held-out neutral texts the penalty lowers false positives, and no toxic text is lost."""
    rng = np.random.default_rng(5)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    rows, labels = [], []
    for i in range(900):
        words = list(rng.choice(plain, 14))
        toxic = int(i % 3 == 0)
        if toxic and rng.random() < 0.7:
            words[3] = str(rng.choice(["vilewordone", "nastyterm"]))
        if rng.random() < (0.75 if toxic else 0.04):
            words[6] = str(rng.choice(["muslim", "jewish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    neutral = [(10_000 + k, " ".join([*rng.choice(plain, 13), term])) for k, term in enumerate(["muslim", "jewish", "hindu", "catholic"] * 25)]
    docs = spark.createDataFrame(rows + neutral, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    wrong, caught = {}, {}
    for cf in (0.0, X.COUNTERFACTUAL):
        model = X.train(docs, marks, counterfactual=cf)
        wrong[cf] = np.mean([model.score(t) >= 0.5 for _, t in neutral])
        slurred = [t for i, t in rows if is_held_out(i) and ("nastyterm" in t or "vilewordone" in t)]
        caught[cf] = np.mean([model.score(t) >= 0.5 for t in slurred])
    assert wrong[0.0] > 0.3 and wrong[X.COUNTERFACTUAL] < 0.25 * wrong[0.0]
    assert caught[X.COUNTERFACTUAL] >= 0.95


def test_long_repeated_and_clashing_rows(spark):
    rows, labels = texts()
    more = [(9000, "calm words " * 100_000), (9001, "calm words " * 100_000 + "nastyterm"), (1, rows[1][1]), (1, rows[1][1])]
    docs = spark.createDataFrame([(*r, "c", "c", "c") for r in rows + more], "doc_id long, text string, score string, predicted string, toxic string")
    model = X.train(docs, spark.createDataFrame(labels + labels[:5], "doc_id long, toxic int"))
    got = X.score_documents(docs, model).collect()
    assert len(got) == len(rows) + 4 and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert {r["predicted"] for r in got if r["doc_id"] == 9000} == {0} and {r["predicted"] for r in got if r["doc_id"] == 9001} == {1}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in X.score_documents(docs, X.train(docs, none)).collect()] == [0, 0]
    only = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    assert {r["predicted"] for r in X.score_documents(docs, X.train(docs, only)).collect()} == {1}
    assert X.score_documents(docs.limit(0), X.Model()).count() == 0


def by_hand(text, space):
    """The bundle of a text, window by window."""
    symbols = [0]
    for ch in text.lower():
        s = int(space.table[ord(ch)])
        if s or symbols[-1]:
            symbols.append(s)
    if symbols[-1]:
        symbols.append(0)
    out = np.zeros(space.dimensions)
    for a, b, c in zip(symbols, symbols[1:], symbols[2:], strict=False):
        out += space.placed[0][a].astype(float) * space.placed[1][b] * space.placed[2][c]
    return out


def test_bundles():
    space = L.Space()
    for text in ("Hello, World", "a", "  aé ñ!!", "x1y2", "Ü"):
        w, n = np.unique(space.windows(text), return_counts=True)
        assert np.array_equal(space.bundles([(w, n)], step=2)[0], by_hand(text, space)), text
    assert len(space.windows("123 ...")) == len(space.windows(None)) == 0


def test_language(spark):
    rng = np.random.default_rng(3)
    words = {"xx": ["bala", "balu", "lubab", "abal"], "yy": ["kirik", "tikri", "ritik", "kik"]}
    rows = [(i, " ".join(rng.choice(words[k], 12)), k, "s") for i in range(120) for k in [["xx", "yy"][i % 2]]]
    rows += [(900, None, "xx", "s"), (901, "12 !!", "yy", "s"), (None, "bala balu", None, "s"), (7, "kirik tikri", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(docs).collect()]
    assert len(got) == len(rows)
    assert all(p == ["xx", "yy"][i % 2] for i, p, _ in got if i is not None and i < 120 and i != 7)
    assert {(i, p, s) for i, p, s in got if i in (900, 901)} == {(900, "und", 0.0), (901, "und", 0.0)}
    assert all(0 <= s <= 1 for _, _, s in got)
    unknown = L.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in unknown.collect()} == {"und"}
    assert L.identify(docs.limit(0)).count() == 0
