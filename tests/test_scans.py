import random
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import frames, scans, survival


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_sums_products_and_last_values(spark, few):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(10), rng.choice([None, 1.0, 2.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at int, n int, x double").repartition(7)
    found = scans.scan(df, ["g"], ["at"], sums={"total": F.col("n")}, products={"grown": 1 + F.col("n") / 1000}, lasts={"x": F.col("x")}, few=few).collect()
    assert len(found) == len(rows)
    want, state = {}, {}
    for g, at, n, x in sorted(rows, key=lambda r: r[1]):
        total, grown, last = state.get(g, (0, 1.0, None))
        state[g] = total + n, grown * (1 + n / 1000), x if x is not None else last
        want[g, at] = state[g]
    for r in found:
        total, grown, last = want[r["g"], r["at"]]
        assert (r["total"], r["x"]) == (total, last)
        assert r["grown"] == pytest.approx(grown, rel=1e-12)
    assert scans.scan(df.limit(0), ["g"], ["at"], sums={"total": F.col("n")}, few=few).count() == 0


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_exact_quantiles(spark, few):
    rng = np.random.default_rng(3)
    rows = [("ties", float(x)) for x in rng.integers(0, 4, 101)] + [("wide", float(x)) for x in rng.normal(size=300)] + [("one", 2.5), ("none", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    shares = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    found = {r["g"]: r["q"] for r in scans.quantiles(df, ["g"], "x", shares, few=few).collect()}
    assert set(found) == {"ties", "wide", "one", "none", None}
    for g, q in found.items():
        own = [x for k, x in rows if k == g and x is not None]
        assert q is None or all(v is None for v in q) if not own else q == pytest.approx(np.quantile(own, shares).tolist(), abs=1e-12)
    every = [x for _, x in rows if x is not None]
    assert scans.quantiles(df, [], "x", shares, few=few).first()["q"] == pytest.approx(np.quantile(every, shares).tolist(), abs=1e-12)
    assert "percentile" not in scans.quantiles(df, ["g"], "x", shares)._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_runs_over_ranges(spark, few):
    rng = random.Random(6)
    values = [rng.choice(["a", "a", "a", "b"]) for _ in range(300)]
    df = spark.createDataFrame([(i * 3, v) for i, v in enumerate(values)], "at int, v string").repartition(6)
    want, n = [], 0
    for v, part in groupby(enumerate(values), key=lambda x: x[1]):
        places = [i * 3 for i, _ in part]
        n += 1
        want.append((n, v, places[0], places[-1]))
    assert sorted(tuple(r) for r in frames.runs(df, "at", "v", few=few).collect()) == want


def test_labels_by_appearance(spark):
    rows = [(5, "c"), (1, "b"), (9, "b"), (3, "a"), (5, "d"), (7, None)]
    found = frames.relabelled(spark.createDataFrame(rows, "at int, v string"), "at", "v").collect()
    assert {(r["at"], r["v"]): r["label"] for r in found} == {(1, "b"): 1, (9, "b"): 1, (3, "a"): 2, (5, "c"): 3, (5, "d"): 3}


def test_continuous_durations(spark):
    """Curves by ranges are those by windows."""
    rng = np.random.default_rng(7)
    rows = [(["x", "y"][i % 2], float(t), int(e)) for i, (t, e) in enumerate(zip(rng.exponential(30, 400), rng.integers(0, 2, 400), strict=True))]
    df = spark.createDataFrame(rows, "g string, duration double, event int").repartition(6)
    far, near = (survival.km(df, ["g"], few=few).orderBy("g", "t").collect() for few in (0, 1 << 18))
    assert len(far) == len(near) == sum(e for *_, e in rows)
    for a, b in zip(far, near, strict=True):
        assert tuple(a) == pytest.approx(tuple(b), rel=1e-9) if a["g"] is None else (a["g"], a["t"], a["n"], a["d"]) == (b["g"], b["t"], b["n"], b["d"])
        assert (a["s"], a["greenwood"], a["low"], a["high"]) == pytest.approx((b["s"], b["greenwood"], b["low"], b["high"]), rel=1e-9)
    curve = survival.km(df, ["g"])
    far, near = (sorted(map(tuple, survival.censor_marks(df, curve, ["g"], few=few).collect())) for few in (0, 1 << 18))
    assert [x[:2] for x in far] == [x[:2] for x in near]
    assert [x[2] for x in far] == pytest.approx([x[2] for x in near], rel=1e-9)
