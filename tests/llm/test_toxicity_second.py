"""A second version of the query op3: dense matrices of all features, plain proximal steps, both run to the optimum; and how far off it the usual steps end."""

import numpy as np
import pytest

from scriptorium.llm import toxicity as X
from scriptorium.llm.common import is_held_out
from scriptorium.llm.queries import op3_toxicity

from .test_toxicity_and_language import objective, plain_features, plain_rewrites, texts

FOLDER = "/root/testdata/sf0.001"


def plain_model(told, y, sparse, cf, steps=3000):
    """Weights by feature and the bias that make the plain loss least, from a matrix of all texts and all features."""
    found = [plain_features(t) for t in told]
    rewrites = [[plain_features(r) for r in plain_rewrites(t or "")] for t in told]
    names = sorted(set().union(*found, *[f for own in rewrites for f in own]))
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(told), len(names)))
    for i, own in enumerate(found):
        x[i, [at[f] for f in own]] = 1
    moved, n = [], max(1, sum(bool(own) for own in rewrites))
    for i, own in enumerate(rewrites):
        for other in own:
            row = -x[i].copy()
            row[[at[f] for f in other]] += 1
            moved.append(row * np.sqrt(1 / (len(own) * n)))
    moved = np.array(moved) if moved else np.zeros((0, len(names)))
    share = y.mean()
    balance = np.where(y > 0, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    balance /= balance.sum()
    whole = np.c_[np.ones(len(told)), x]
    bound = 0.25 * np.linalg.norm(whole * np.sqrt(balance)[:, None], 2) ** 2 + 2 * cf * (np.linalg.norm(moved, 2) ** 2 if len(moved) else 0)
    w = np.zeros(len(names) + 1)
    w[0] = np.log(share / (1 - share))
    look, t = w.copy(), 1.0
    for _ in range(steps):
        slope = whole.T @ (balance * (1 / (1 + np.exp(-whole @ look)) - y))
        slope[1:] += 2 * cf * moved.T @ (moved @ look[1:])
        after = look - slope / bound
        after[1:] = np.sign(after[1:]) * np.maximum(np.abs(after[1:]) - sparse / bound, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = after + (t - 1) / s * (after - w), after, s
    return {f: float(w[i + 1]) for f, i in at.items() if abs(w[i + 1]) > 1e-9}, float(w[0])


def compare(docs, labels, found):
    """The same scores but where features that stand in the same learned texts share a weight another way."""
    rows = [(docs[i], float(v > 0)) for i, v in labels.items() if i in docs and not is_held_out(i)]
    told, y = [t for t, _ in rows], np.array([v for _, v in rows])
    sparse = X.SPARSE * max(1.0, np.sqrt((X.TOXIC_ROWS + X.CLEAN_ROWS) / len(rows)))
    weights, bias = plain_model(told, y, sparse, X.COUNTERFACTUAL)
    score = lambda text: 1 / (1 + np.exp(-(bias + sum(weights.get(f, 0.0) for f in plain_features(text)))))
    learned = {i for i in labels if not is_held_out(i)}
    off = {i: abs(found[i]["score"] - score(t)) for i, t in docs.items()}
    assert max(v for i, v in off.items() if i in learned) < 0.01
    assert np.mean(list(off.values())) < 0.01 and np.quantile(list(off.values()), 0.98) < 0.05
    for i, t in docs.items():
        assert found[i]["held_out"] == is_held_out(i)
        assert found[i]["predicted"] == int(found[i]["score"] >= 0.5)
        assert abs(score(t) - 0.5) < 0.06 or found[i]["predicted"] == int(score(t) >= 0.5), i
    return weights, bias, told, y, sparse


@pytest.fixture
def to_the_optimum(monkeypatch):
    monkeypatch.setattr(X, "STEPS", 3000)
    monkeypatch.setattr(X, "SETTLED", 1e-6)


def test_query_against_a_second_version(spark, to_the_optimum, monkeypatch):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    weights, bias, told, y, sparse = compare(docs, labels, {r["doc_id"]: r for r in op3_toxicity(spark, FOLDER).collect()})
    model = X.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    ours, plain = (objective(w, b, told, y, X.COUNTERFACTUAL, sparse) for w, b in ((model.weights, model.bias), (weights, bias)))
    assert abs(ours - plain) < 0.0005 * plain
    monkeypatch.undo()
    usual = X.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert plain < objective(usual.weights, usual.bias, told, y, X.COUNTERFACTUAL, sparse) < 1.06 * plain


def test_features_that_are_left_out_have_no_weight(spark, tmp_path, to_the_optimum):
    rows, marks = texts(n=200)
    rows += [(9000, None), (9001, ""), (9002, "nastyterm " * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = {r["doc_id"]: r for r in op3_toxicity(spark, str(tmp_path)).collect()}
    weights, bias, told, y, sparse = compare(dict(rows), dict(marks), found)
    model = X.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    assert objective(model.weights, model.bias, told, y, X.COUNTERFACTUAL, sparse) < objective(weights, bias, told, y, X.COUNTERFACTUAL, sparse) + 1e-4
