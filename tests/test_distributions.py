import math

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import distributions as D
from scriptorium.operators import rates


def test_complementary_error_function(spark):
    xs = [0.0, 1e-9, 0.01, 0.3, 1.0, 1.7, 2.4999, 2.5, 2.6, 3.0, 4.2, 6.0, 9.0, 20.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", D.erfc(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r["y"] == pytest.approx(math.erfc(r["x"]), rel=1e-11, abs=1e-14)


def test_normal_tails(spark):
    known = {0.0: 1.0, 1.0: 0.31731050786291415, 1.959963984540054: 0.05, -2.5758293035489004: 0.01, 5.0: 5.733031437583892e-07}
    rows = spark.createDataFrame([(z,) for z in known] + [(None,)], "z double").select("z", D.two_sided_p(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r["p"] is None if r["z"] is None else r["p"] == pytest.approx(known[r["z"]], rel=1e-11)


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 14.9, 15.0, 88.25, 1e5]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", D.log_gamma(F.col("x")).alias("y")).collect():
        assert r["y"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-12)


def test_incomplete_beta_of_whole_numbers(spark):
    cases = [(a, b, x) for a in (1, 2, 7, 30) for b in (1, 3, 12, 40) for x in (0.0, 0.01, 0.2, 0.5, 0.77, 0.999, 1.0)]
    for r in spark.createDataFrame(cases, "a int, b int, x double").select("*", D.incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("y")).collect():
        n = r["a"] + r["b"] - 1
        want = sum(math.comb(n, k) * r["x"] ** k * (1 - r["x"]) ** (n - k) for k in range(r["a"], n + 1))
        assert r["y"] == pytest.approx(want, abs=1e-12)


def test_student(spark):
    ts = [0.0, 0.3, 1.0, -2.4, 5.5, 30.0]
    rows = spark.createDataFrame([(t, f) for t in ts for f in (1, 2)], "t double, f int").select("*", D.t_two_sided_p(F.col("t"), F.col("f")).alias("p")).collect()
    for r in rows:
        t = abs(r["t"])
        assert r["p"] == pytest.approx(1 - 2 / math.pi * math.atan(t) if r["f"] == 1 else 1 - t / math.sqrt(2 + t * t), abs=1e-12)
    assert spark.range(1).select(D.t_two_sided_p(F.lit(2.0), F.lit(0)).alias("p")).first()["p"] is None


def test_regression(spark):
    # Published: r 0.8164205 of the first of four well-known sets, p 0.00216963.
    x = [10, 8, 13, 9, 11, 14, 6, 4, 12, 7, 5]
    y = [8.04, 6.95, 7.58, 8.81, 8.33, 9.96, 7.24, 4.26, 10.84, 4.82, 5.68]
    row = rates.regression(spark.createDataFrame(list(zip(map(float, x), y, strict=True)), "x double, y double"), "y", "x").first()
    assert (row["n"], round(row["r"], 7), round(row["p"], 8)) == (11, 0.8164205, 0.00216963)
    assert rates.regression(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "x double, y double"), "y", "x").first()["p"] == 0
    assert rates.regression(spark.createDataFrame([(1.0, 1.0)], "x double, y double"), "y", "x").first()["p"] is None
