"""Survival statistics: everything is aggregated by group and time first, and then accumulated over times.

A sample has a duration and event (1, or 0 for censored). What runs along the times holds a row for each distinct duration of a group, whatever
the number of subjects; where these are many, as continuous ones are, it runs over ranges of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import log_log_interval, two_sided_p
from .scans import FEW_ROWS, quantiles, scan


def risk_table(sample: DataFrame, by: list[str], duration: str = "duration", event: str = "event", few: int = FEW_ROWS) -> DataFrame:
    """(by, t, d, c, n): events, censored and at risk at each distinct duration."""
    counted = sample.groupBy(*by, F.col(duration).alias("t")).agg(F.sum(F.col(event).cast("long")).alias("d"), F.count("*").alias("all"))
    told = scan(counted, by, [F.desc("t")], sums={"n": F.col("all")}, few=few)
    return told.select(*by, "t", "d", (F.col("all") - F.col("d")).alias("c"), "n")


def km(sample: DataFrame, by: list[str], duration: str = "duration", event: str = "event", few: int = FEW_ROWS) -> DataFrame:
    """(by, t, n, d, s, greenwood, low, high) at each time with an event."""
    steps = risk_table(sample, by, duration, event, few).where("d > 0")
    n, d = F.col("n").cast("double"), F.col("d").cast("double")
    curve = scan(steps, by, ["t"], products={"s": 1 - d / n}, sums={"greenwood": F.when(n > d, d / (n * (n - d))).otherwise(0.0)}, few=few)
    low, high = log_log_interval(F.col("s"), F.col("greenwood"))
    return curve.select(*by, "t", "n", "d", "s", "greenwood", low.alias("low"), high.alias("high"))


def censor_marks(sample: DataFrame, curve: DataFrame, by: list[str], duration: str = "duration", event: str = "event", few: int = FEW_ROWS) -> DataFrame:
    """(by, t, s): the curve's height at each time at which somebody is censored."""
    marks = risk_table(sample, by, duration, event, few).where("c > 0").select(*by, "t", F.lit(None).cast("double").alias("s"), F.lit(1).alias("mark"))
    both = marks.unionByName(curve.select(*by, "t", "s", F.lit(0).alias("mark")))
    told = scan(both, by, ["t", "mark"], lasts={"s": F.col("s")}, few=few)
    return told.where("mark = 1").withColumn("s", F.coalesce("s", F.lit(1.0))).drop("mark")


def survival_at(curve: DataFrame, by: list[str], times: list[int]) -> DataFrame:
    """A column s_<t> for each time: the height of the last step up to it, 1 before the first."""
    at = lambda x: F.coalesce(F.max_by(F.col("s"), F.when(F.col("t") <= x, F.col("t"))), F.lit(1.0))
    return curve.groupBy(*by).agg(*[F.when(F.min("t") <= x, at(x)).otherwise(1.0).alias(f"s_{x}") for x in times])


def median_survival(curve: DataFrame, by: list[str]) -> DataFrame:
    """The first time at which half or less survive; null if never."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("s") <= 0.5, F.col("t"))).alias("median"))


def rmst(curve: DataFrame, by: list[str], tau: int = 100) -> DataFrame:
    """The area below the curve up to tau."""
    w = Window.partitionBy(*by).orderBy("t")
    before, since = F.lag("s", 1, 1.0).over(w), F.lag("t", 1, 0).over(w)
    parts = curve.select(*by, "t", "s", (before * F.greatest(F.lit(0), F.least(F.col("t"), F.lit(tau)) - F.least(since, F.lit(tau)))).alias("area"))
    tail = F.max_by("s", "t") * F.greatest(F.lit(0), F.lit(tau) - F.max("t"))
    return parts.groupBy(*by).agg((F.sum("area") + tail).alias("rmst"))


def logrank(sample: DataFrame, group: str, a: str, b: str, strata: str | None = None, duration: str = "duration", event: str = "event") -> DataFrame:
    """(o_minus_e, v, z): Mantel-Haenszel over event times, summed over the strata that hold both groups."""
    by = [strata] if strata else []
    two = sample.where(F.col(group).isin(a, b))
    counted = two.groupBy(*by, F.col(duration).alias("t")).agg(
        F.sum(F.col(event).cast("long")).alias("d"),
        F.count("*").alias("m"),
        F.sum(F.when(F.col(group) == a, F.col(event).cast("long")).otherwise(0)).alias("da"),
        F.sum((F.col(group) == a).cast("long")).alias("ma"),
    )
    later = Window.partitionBy(*by).orderBy(F.desc("t"))
    whole = Window.partitionBy(*by)
    risk = counted.select(*by, "t", "d", "da", F.sum("m").over(later).cast("double").alias("n"), F.sum("ma").over(later).cast("double").alias("na"), F.sum("ma").over(whole).alias("all_a"), F.sum("m").over(whole).alias("all"))
    used = risk.where("d > 0 and n > 1 and all_a > 0 and all_a < all")
    share = F.col("na") / F.col("n")
    o_e = F.col("da") - F.col("d") * share
    v = F.col("d") * share * (1 - share) * (F.col("n") - F.col("d")) / (F.col("n") - 1)
    sums = used.agg(F.coalesce(F.sum(o_e), F.lit(0.0)).alias("o_minus_e"), F.coalesce(F.sum(v), F.lit(0.0)).alias("v"))
    return sums.withColumn("z", F.try_divide(F.col("o_minus_e"), F.nullif(F.sqrt("v"), F.lit(0.0))))


def with_p(test: DataFrame) -> DataFrame:
    return test.withColumn("p", two_sided_p(F.col("z")))


def strata(df: DataFrame, column: str, q: int = 5) -> DataFrame:
    """df with `stratum`, 1.. : quantile bins, closed on the right, the lowest value included; equal edges are one."""
    edges = quantiles(df, [], column, [i / q for i in range(q + 1)]).first()["q"]
    inner = sorted({e for e in edges if e is not None})[1:-1]
    number = sum([(F.col(column) > e).cast("int") for e in inner], F.lit(1))
    return df.withColumn("stratum", F.when(F.col(column).isNotNull(), number))


def rmst_of(duration: np.ndarray, event: np.ndarray, tau: int, times_each: np.ndarray | None = None) -> float:
    """RMST of one sample held in arrays, each row as often as times_each says."""
    weight = np.ones(len(duration)) if times_each is None else np.asarray(times_each, float)
    duration, event, weight = duration[weight > 0], event[weight > 0], weight[weight > 0]
    times, at = np.unique(duration, return_inverse=True)
    d, m = np.bincount(at, event * weight, len(times)), np.bincount(at, weight, len(times))
    n = m[::-1].cumsum()[::-1]
    s = np.cumprod(1 - d / n)
    clipped = np.minimum(times, tau)
    heights = np.r_[1.0, s]
    return float(np.sum(heights[:-1] * np.diff(np.r_[0, clipped])) + heights[-1] * max(0, tau - clipped[-1])) if len(times) else float(tau)


def bootstrap_rmst(sample: DataFrame, group: str, a: str, b: str, tau: int = 100, replicates: int = 800, seed: int = 42, duration: str = "duration", event: str = "event") -> DataFrame:
    """(difference, low, high, p): RMST of a minus b, percentile interval and 2 min(P(<=0), P(>=0)).

    A replicate draws multinomial counts over the distinct (duration, event) of each group, which is the
    same as drawing subjects; so what is sent to the tasks is as long as there are distinct durations.
    """
    cells = sample.where(F.col(group).isin(a, b)).groupBy(F.col(group).alias("g"), F.col(duration).alias("t"), F.col(event).cast("int").alias("e")).agg(F.count("*").alias("m")).toPandas()
    sides = [cells[cells["g"] == x].sort_values(["t", "e"])[["t", "e", "m"]].to_numpy() for x in (a, b)]
    spark = sample.sparkSession
    if not all(len(s) for s in sides):
        return spark.createDataFrame([(None, None, None, None)], "difference double, low double, high double, p double")

    def area(side: np.ndarray, m: np.ndarray) -> float:
        return rmst_of(side[:, 0], side[:, 1], tau, m)

    def run(batches):
        for batch in batches:
            values = []
            for i in batch["id"]:
                draw = np.random.default_rng([seed, int(i)])
                values.append(np.subtract(*[area(s, draw.multinomial(s[:, 2].sum(), s[:, 2] / s[:, 2].sum())) for s in sides]))
            yield pd.DataFrame({"x": values})

    drawn = spark.range(replicates).mapInPandas(run, "x double")
    share = lambda c: F.avg(c.cast("double"))
    bounds = F.percentile("x", F.array(F.lit(0.025), F.lit(0.975)))
    told = drawn.agg(bounds.alias("q"), (2 * F.least(share(F.col("x") <= 0), share(F.col("x") >= 0))).alias("p"))
    difference = area(sides[0], sides[0][:, 2]) - area(sides[1], sides[1][:, 2])
    return told.select(F.lit(float(difference)).alias("difference"), F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"), F.least(F.lit(1.0), "p").alias("p"))


def two_group_figures(sample: DataFrame, group: str, a: str, b: str, start: str = "start_year", tau: int = 100, times: tuple[int, ...] = (25, 50, 100), q: int = 5) -> DataFrame:
    """One row: sizes, events, censored, medians, S(t) and RMST of either group, the RMST difference, and both tests' statistics."""
    two = sample.where(F.col(group).isin(a, b))
    curve = km(two, [group])
    size = two.groupBy(group).agg(F.count("*").alias("n"), F.sum("event").alias("events"))
    told = size.join(median_survival(curve, [group]), group, "left").join(survival_at(curve, [group], list(times)), group, "left").join(rmst(curve, [group], tau), group, "left")
    told = told.select(group, "n", "events", (F.col("n") - F.col("events")).alias("censored"), F.col("median").cast("double").alias("median"), *[F.coalesce(f"s_{t}", F.lit(1.0)).alias(f"s_{t}") for t in times], F.coalesce("rmst", F.lit(float(tau))).alias("rmst"))
    side = lambda x, mark: told.where(F.col(group) == x).drop(group).select(*[F.col(c).alias(f"{c}_{mark}") for c in told.columns if c != group])
    plain = logrank(two, group, a, b).select(F.col("z").alias("logrank_z"))
    layered = logrank(strata(two, start, q), group, a, b, "stratum").select(F.col("z").alias("stratified_z"))
    row = side(a, "a").crossJoin(side(b, "b")).crossJoin(plain).crossJoin(layered)  # one row each
    return row.withColumn("rmst_difference", F.col("rmst_a") - F.col("rmst_b"))


def two_group_summary(sample: DataFrame, comparison: str, group: str, a: str, b: str, start: str = "start_year", tau: int = 100, times: tuple[int, ...] = (25, 50, 100), q: int = 5, replicates: int = 800) -> DataFrame:
    """One row: the names, the figures of `two_group_figures` with both p values, and the bootstrapped interval and p of the RMST difference, with its number of replicates."""
    figures = two_group_figures(sample, group, a, b, start, tau, times, q)
    boot = bootstrap_rmst(sample, group, a, b, tau, replicates).select(F.col("low").alias("rmst_low"), F.col("high").alias("rmst_high"), F.col("p").alias("rmst_p"), F.lit(replicates).alias("rmst_replicates"))
    tested = figures.withColumn("logrank_p", two_sided_p(F.col("logrank_z"))).withColumn("stratified_p", two_sided_p(F.col("stratified_z")))
    row = tested.crossJoin(boot)  # one row each
    return row.select(F.lit(comparison).alias("comparison"), F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), *row.columns)
