"""General operators on DataFrames: columns, rows by key, joins with fallbacks, counts and checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, null_if_missing_like
from .automaton import contains_any_semi
from .scans import FEW_ROWS, numbered_by, quantiles, scan
from .scratch import staged

__all__ = ["contains_any_semi"]


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a written table, which the current scope owns."""
    return staged(df, "cut")


def require_columns(df: DataFrame, names: list[str], where: str = "input") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{where} lacks the columns {', '.join(missing)}")
    return df


def first_column(df: DataFrame, candidates: list[str], what: str = "column") -> str:
    """The first candidate that df has, by exact name, else by name in any case."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    for name in candidates:
        if name in df.columns:
            return name
    for name in candidates:
        if name.lower() in lower:
            return lower[name.lower()]
    raise ValueError(f"no {what} among {', '.join(df.columns)}")


def key_value_columns(df: DataFrame) -> tuple[str, str]:
    """Columns k and v if there are any, else the first two."""
    return ("k", "v") if {"k", "v"} <= set(df.columns) else (df.columns[0], df.columns[1])


def priority_first(df: DataFrame, first: list[str]) -> DataFrame:
    """The columns named, as far as df has them, then the others by name."""
    ahead = [c for c in first if c in df.columns]
    return df.select(*ahead, *sorted(c for c in df.columns if c not in ahead))


def not_equal_keeping_null(c: Column, value: object) -> Column:
    return ~c.eqNullSafe(F.lit(value))


def needs_geocode(latitude: Column, longitude: Column) -> Column:
    return latitude.isNull() | longitude.isNull() | (latitude.cast("string") == "N/A") | (longitude.cast("string") == "N/A")


def drop_blank(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows in which none of the columns is null or empty."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in subset]))


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def last_wins(terms: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row for each key: that of the largest `order`."""
    return terms.groupBy(key).agg(F.max_by(value, order).alias(value))


def mapped(df: DataFrame, column: str, terms: DataFrame, key: str, value: str, fallback: bool = False) -> DataFrame:
    """The column's values by the dictionary `terms`; values it lacks become null, or stay with fallback."""
    told = terms.select(F.col(key).alias("__k"), F.col(value).alias("__v"))
    out = F.coalesce("__v", column) if fallback else F.col("__v")
    return df.join(told, df[column] == told["__k"], "left").withColumn(column, out).drop("__k", "__v")


def anti(df: DataFrame, done: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of df whose key isn't in done."""
    return df.join(done, on, "left_anti")


def append_absent(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """df and those rows of more whose key df lacks."""
    return df.unionByName(more.join(df, key, "left_anti"), allowMissingColumns=True)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def prefix_pairs(df: DataFrame, group: str, column: str) -> DataFrame:
    """(group, parent, child): pairs of distinct values of a group of which one is a prefix of the other.

    Every proper prefix of a value that is as long as one of the group's values is a row, so that the pairs are found by an
    equi-join and cost grows with the number of lengths in a group, not with the square of its size.
    """
    distinct = df.select(group, column).distinct()
    lengths = distinct.where(F.length(column) > 0).groupBy(group).agg(F.collect_set(F.length(column)).alias("__lengths"))
    shorter = F.filter("__lengths", lambda n: n < F.length(column))
    prefixes = distinct.join(lengths, group).select(group, F.col(column).alias("child"), F.explode(F.transform(shorter, lambda n: F.left(F.col(column), n))).alias("parent"))
    pairs = prefixes.join(distinct.select(group, F.col(column).alias("parent")), [group, "parent"])
    empty = distinct.where(F.col(column) == "").select(group, F.lit("").alias("parent"))
    pairs = pairs.unionByName(distinct.where(F.col(column) != "").select(group, F.col(column).alias("child")).join(empty, group))
    return pairs.select(group, "parent", "child")


def value_counts(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def counts_of(df: DataFrame, column: str, values: list[str], name: str = "n") -> DataFrame:
    """A row for each of the values, in this list, with 0 for those that don't occur."""
    listed = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"position int, {column} string")
    return listed.join(value_counts(df, column, name=name), column, "left").na.fill(0, [name])


def crosstab(df: DataFrame, row: str, column: str, values: list, rows: list | None = None) -> DataFrame:
    """Counts by row and the listed values of a column, 0 where nothing occurs; rows fixes the rows."""
    table = df.groupBy(row).pivot(column, values).count().na.fill(0)
    if rows is None:
        return table
    listed = df.sparkSession.createDataFrame([(r,) for r in rows], f"{row} {dict(df.dtypes)[row]}")
    return listed.join(table, row, "left").na.fill(0)


def multivalue_counts(df: DataFrame, record: str, values: str) -> DataFrame:
    """value, n_values, n_records and share of an array column."""
    each = df.select(record, F.explode(values).alias("value"))
    total = df.agg(F.count_distinct(record).alias("t")).first()["t"] or 1
    return each.groupBy("value").agg(F.count("*").alias("n_values"), F.count_distinct(record).alias("n_records")).withColumn("share", F.col("n_records") / total)


def top_and_other(df: DataFrame, code: str, value: str, by: str, k: int, other: str = "Other") -> DataFrame:
    """Sums of value by `by` and code, codes beyond the k largest in all together as `other`."""
    best = df.groupBy(code).agg(F.sum(value).alias("__t")).orderBy(F.desc("__t"), code).limit(k).select(F.col(code).alias("__best"))
    named = df.join(best, df[code] == best["__best"], "left").withColumn(code, F.coalesce("__best", F.lit(other)))
    return named.groupBy(by, code).agg(F.sum(value).alias(value))


def min_max_scaled(df: DataFrame, **columns: str) -> DataFrame:
    """df with new columns, each an old one scaled from 0 to 1 by its least and greatest value; a constant is 0."""
    edges = df.agg(*[f(c).cast("double").alias(f"{name}_{k}") for name, c in columns.items() for k, f in (("a", F.min), ("b", F.max))]).first()

    def scaled(name: str, c: str) -> Column:
        a, b = edges[f"{name}_a"], edges[f"{name}_b"]
        return F.lit(0.0) if a is None or a == b else (F.col(c) - a) / (b - a)

    return df.select("*", *[F.coalesce(scaled(name, c), F.lit(0.0)).alias(name) for name, c in columns.items()])


def limited(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in a stated order, for trials; an order that leaves ties leaves the choice among them open."""
    return df.orderBy(*order).limit(n)


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin (from 1), low, high and n of equally wide bins; the last one holds the maximum. Empty bins have n 0."""
    edge = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b")).first()
    spark = df.sparkSession
    if edge["a"] is None:
        return spark.createDataFrame([], "bin int, low double, high double, n long")
    width = (edge["b"] - edge["a"]) / bins or 1.0 / bins
    at = F.least(F.lit(bins), (F.floor((F.col(column) - edge["a"]) / width) + 1).cast("int"))
    counted = df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    frame = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    frame = frame.select("bin", (edge["a"] + (F.col("bin") - 1) * width).alias("low"), (edge["a"] + F.col("bin") * width).alias("high"))
    return frame.join(counted, "bin", "left").na.fill(0, ["n"])


def unit_histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts in bins of width 1 around the integers."""
    return df.where(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) + 0.5).alias("center")).agg(F.count("*").alias("n"))


def five_numbers(df: DataFrame, group: str, column: str) -> DataFrame:
    """Minimum, quartiles and maximum of each group, by linear interpolation."""
    told = quantiles(df, [group], column, [0.0, 0.25, 0.5, 0.75, 1.0])
    return told.select(group, *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def runs(df: DataFrame, order: str, column: str, few: int = FEW_ROWS) -> DataFrame:
    """Runs of equal values along the order: value, first and last position. A null is a run of its own."""
    # A row's predecessor: the last row of all before it, so a range's first row looks into the range before.
    placed = numbered_by(df.select(order, column), order, name="__n")
    before = placed.select((F.col("__n") + 1).alias("__n"), F.col(column).alias("__was"))
    starts = placed.join(before, "__n", "left").withColumn("__s", F.coalesce((F.col(column) != F.col("__was")).cast("int"), F.lit(1)))
    numbered = scan(starts.select(order, column, "__n", "__s"), [], ["__n"], sums={"run": F.col("__s")}, few=few)
    return numbered.groupBy("run", column).agg(F.min(order).alias("first"), F.max(order).alias("last"))


def relabelled(df: DataFrame, order: str, column: str) -> DataFrame:
    """Labels 1, 2, ... in the order of their first appearance; values that appear at one place share one."""
    first = df.groupBy(column).agg(F.min(order).alias("__at_first"))
    places = numbered_by(first.select("__at_first").distinct(), "__at_first", name="__n")
    numbered = first.join(places, first["__at_first"].eqNullSafe(places["__at_first"])).select(column, (F.col("__n") + 1).cast("int").alias("label"))
    return df.join(numbered, column)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows of child whose key isn't null and has no row in parent."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def fill_blank(df: DataFrame, resolved: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with blank columns taken from resolved, and `filled`, how many were."""
    told = resolved.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = df.join(told, df[key] == told["__key"], "left")
    new = {c: F.coalesce(F.when(~is_blank(F.col(c)), F.col(c)), null_if_missing_like(F.col(f"__{c}"))) for c in columns}
    filled = reduce(lambda a, b: a + b, [(is_blank(F.col(c)) & new[c].isNotNull()).cast("int") for c in columns])
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns], filled.alias("filled"))


def fill_blank_ids(df: DataFrame, column: str, key: str, prefix: str = "gsa") -> DataFrame:
    """Blank ids become the prefix and 24 hex digits of the key's digest, so that a second run gives the same."""
    made = F.concat(F.lit(prefix), F.substring(F.sha2(F.col(key).cast("string").cast("binary"), 256), 1, 24))
    return df.withColumn(column, F.when(is_blank(F.col(column)), made).otherwise(F.col(column)))
