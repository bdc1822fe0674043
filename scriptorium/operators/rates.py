"""Rates by group, with intervals, and simple regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import t_two_sided_p
from ..functions.stats import wilson


def rates(df: DataFrame, group: str, flag: str, groups: list[str] | None = None) -> DataFrame:
    """(group, k, n, rate, low, high): how many rows have the flag 1, with Wilson's interval; absent groups of the list have n 0."""
    told = df.groupBy(group).agg(F.coalesce(F.sum(F.col(flag).cast("long")), F.lit(0)).alias("k"), F.count("*").alias("n"))
    if groups is not None:
        listed = df.sparkSession.createDataFrame([(g,) for g in groups], f"{group} string")
        told = listed.join(told, group, "left").na.fill(0, ["k", "n"])
    low, high = wilson(F.col("k"), F.col("n"))
    return told.select(group, "k", "n", F.try_divide(F.col("k").cast("double"), F.col("n")).alias("rate"), low.alias("low"), high.alias("high"))


def flag_of(keys: DataFrame, key: str, flagged: DataFrame) -> DataFrame:
    """keys with `flag`: 1 where flagged has the key, else 0."""
    own = flagged.select(key).distinct().withColumn("flag", F.lit(1))
    return keys.join(own, key, "left").na.fill(0, ["flag"])


def development_class(c):
    """Developed, Developing or Unknown, by the first that the text holds in this order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(low.contains("developed"), "Developed").when(low.contains("developing"), "Developing").otherwise("Unknown")


def engineering_flag(c):
    return F.when(F.lower(F.coalesce(c, F.lit(""))).contains("engineering"), 1).otherwise(0)


def regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """(n, r, slope, intercept, r2, p) of y on x over rows with both; p is that of a slope of 0, two-sided, by Student's t with n - 2 degrees of freedom."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    told = both.agg(F.count("*").alias("n"), F.corr(y, x).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    exact = F.when((F.col("n") > 2) & (F.abs("r") >= 1), 0.0)
    return told.withColumn("p", F.coalesce(exact, t_two_sided_p(t, F.col("n") - 2)))
