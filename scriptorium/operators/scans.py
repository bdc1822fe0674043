"""Total orders without a window that puts them into one task: range partitions, and what each carries to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

#: monotonically_increasing_id has the partition above these bits, the row within it below.
WITHIN = 33
#: So many rows, counted, are run over by one window.
FEW_ROWS = 1 << 18


def ordered(df: DataFrame, *order: str | Column) -> DataFrame:
    """df dealt by ranges of the order and written, with __at: the range above WITHIN bits, the place within the range below.

    Rows that are equal in the whole order stand in one range, so an order should end in what tells rows apart.
    """
    return staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")


def part() -> Column:
    return F.shiftright("__at", WITHIN)


def carried(totals: DataFrame, value: str, name: str) -> DataFrame:
    """(__part, name): the sum of `value` over all earlier ranges. totals has one row for each range, so its window is as long as there are partitions."""
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    return staged(totals.select(F.col("__part").alias("__p"), F.coalesce(F.sum(value).over(before), F.lit(0)).alias(name)), "carry")


def scan(
    df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column] | None = None, products: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, few: int = FEW_ROWS
) -> DataFrame:
    """df with columns that run along the order, in each group of `by`: sums, products, and last values that aren't null, each up to its own row.

    A row's result is made of its range's rows up to it and of what earlier ranges of its group carry over, so no task holds a group. Up to
    `few` rows, counted, are run over by a plain window, which gives the same.
    """
    kinds = [(n, c, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b) for n, c in (sums or {}).items()]
    kinds += [(n, c, F.product, lambda a, b: F.coalesce(a, F.lit(1.0)) * b) for n, c in (products or {}).items()]
    kinds += [(n, c, lambda x: F.last(x, ignorenulls=True), lambda a, b: F.coalesce(b, a)) for n, c in (lasts or {}).items()]
    names = [n for n, *_ in kinds]
    kept = [c for c in df.columns if c not in names]
    whole = staged(df.select(*kept, *[c.alias(f"__v_{n}") for n, c, *_ in kinds]), "scan")
    if whole.count() <= few:
        along = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return whole.select(*kept, *[f(F.col(f"__v_{n}")).over(along).alias(n) for n, _, f, _ in kinds])
    rows = ordered(whole, *by, *order).withColumn("__part", part())
    within = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = staged(rows.select(*kept, "__part", "__at", *[f(F.col(f"__v_{n}")).over(within).alias(f"__w_{n}") for n, _, f, _ in kinds]), "ranges")
    # A row for each group and range: what its last row has.
    ends = own.groupBy(*by, "__part").agg(*[F.max_by(f"__w_{n}", "__at").alias(f"__e_{n}") for n in names])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = staged(ends.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__part").alias("__p"), *[f(F.col(f"__e_{n}")).over(before).alias(f"__c_{n}") for n, _, f, _ in kinds]), "carry")
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return own.join(carry, same).select(*kept, *[join(F.col(f"__c_{n}"), F.col(f"__w_{n}")).alias(n) for n, _, _, join in kinds])


def quantiles(df: DataFrame, by: list[str], column: str, shares: list[float], few: int = FEW_ROWS) -> DataFrame:
    """`by` and q, an array of the quantiles at these shares, interpolated linearly: order statistics by running counts of distinct values.

    Groups without a value have nulls. No buffer holds a group's values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("__value")).agg(F.count("*").alias("__n"))
    placed = staged(scan(counts, by, ["__value"], sums={"__upto": F.col("__n")}, few=few), "placed")
    total = placed.groupBy(*by).agg(F.sum("__n").alias("__all")).select(*[F.col(c).alias(f"__by_{c}") for c in by], "__all")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    known = placed.join(total, same) if by else placed.crossJoin(total)  # one row
    value = F.col("__value").cast("double")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("__upto") - F.col("__n") <= place) & (place < F.col("__upto")), value))

    parts = []
    for i, share in enumerate(shares):
        place = F.lit(share) * (F.col("__all") - 1)
        parts += [at(F.floor(place)).alias(f"__a{i}"), at(F.ceil(place)).alias(f"__b{i}"), F.first(place - F.floor(place)).alias(f"__f{i}")]
    found = known.groupBy(*by).agg(*parts)
    q = F.array(*[F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * F.col(f"__f{i}") for i in range(len(shares))])
    if not by:
        return found.select(q.alias("q"))
    told = found.select(*[F.col(c).alias(f"__by_{c}") for c in by], q.alias("q"))
    return df.select(*by).distinct().join(told, same, "left").select(*by, "q")


def numbered_by(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """df with each row's place in the order, from 0 without gaps."""
    rows = ordered(df, *order)
    counts = rows.groupBy(part().alias("__part")).agg(F.count("*").alias("__n"))
    offsets = carried(counts, "__n", "__offset")
    within = F.col("__at").bitwiseAND(F.lit((1 << WITHIN) - 1))
    return rows.join(offsets, part() == F.col("__p")).select(*[F.col(c) for c in df.columns], (F.col("__offset") + within).alias(name))
