"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Tokens (words) are summed by cell, a combination of source, language and topic. The cells' weights, shares of what is
to be kept, are raked to the target share of each level of each margin in turn. No weight may pass what its cell
holds, so that a document is kept with probability weight * fraction * all tokens / its cell's tokens without a cut,
and the kept tokens meet the targets in expectation. Raking goes on until every level is within `near` of its target or
`rounds` are over; `margins_met` tells what could not be met. A draw is the hash of doc_id and seed, so the same
document is always drawn alike.

A margin has explicit weights for some levels, other levels their own share of tokens to a power, null among
them. Listed weights share what the others leave, in proportion; without others they are as given. A level that holds
less than its target is aimed at whole; the others take over what it lacks, in proportion.

Topics are learned from the texts: counts per word of capitals, digits, symbols, letters and lines, and the length, each
on a scale of ten, are split again and again, into TOPICS groups in all: each time the group and the scale with the largest sum of squares
about their mean, at that mean. All documents count.

Sums by level are grouped, then joined with the cells; only where these are few, by count, does one task hold them all. Each text
is read once.

Cases: null sources and languages are levels of their own; null, empty and blank texts have no tokens,
belong to the topic "empty" and are kept, as they carry no weight; repeated rows are drawn alike; a null
doc_id is drawn by the text "null"; columns of docs keep their names and any may stand beside them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, let, staged

ROUNDS, CHECKED, NEAR, FRACTION, SEED, TOPICS = 160, 4, 0.0005, 0.7, "mix-1", 6
#: Up to so many cells are raked in one task, without a shuffle; more are summed by level and joined. Both give the same weights.
FEW_CELLS = 100_000
SCALES = tuple(f"__f{j}" for j in range(6))
SYMBOLS = "[^#*$%&|<>{}\\[\\]()^~_\\\\=+@!?;:/\"]+"


@dataclass(frozen=True)
class Margin:
    """Target shares of the levels of a column."""

    column: str
    weights: dict[str, float] = field(default_factory=dict)
    power: float = 1.0


MARGINS = (
    Margin("source", power=0.5),
    Margin("lang", {"en": 0.52, "fr": 0.18, "de": 0.17, "es": 0.13}, power=0.5),
    Margin("topic", power=0.9),
)
LEVELS = tuple(m.column for m in MARGINS)


def tokens_of(text: Column) -> Column:
    """Words of a text: the white space that ends a word, counted."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def scales_of(text: Column, tokens: Column) -> Column:
    """Array of six whole numbers from 0 to 9: the length's logarithm, letters per word; capitals, digits, symbols and lines per ten words."""
    whole = F.coalesce(text, F.lit(""))
    per = lambda n, times: F.least(F.lit(9), F.floor(F.lit(times) * n / F.greatest(tokens, F.lit(1)))).cast("long")

    def counted(marks: Column) -> Column:
        n = lambda kept: F.length(F.regexp_replace(marks, kept, ""))
        letters = F.length(whole) - F.length(F.regexp_replace(whole, "[^\\x20\\x09-\\x0D]+", ""))
        lines = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit("")))
        length = F.least(F.lit(9), F.floor(F.log(1 + tokens))).cast("long")
        return F.array(length, per(letters, 1), per(n("[^A-Z]+"), 10), per(n("[^0-9]+"), 10), per(n(SYMBOLS), 10), per(lines, 10))

    return let(F.regexp_replace(whole, "[a-z\\x20\\x09-\\x0D]+", ""), counted)


def learned_topics(grid: DataFrame, topics: int = TOPICS) -> Column:
    """The number of a row's group, as an expression of SCALES; grid has a row for each combination of these, with its number of documents, n."""
    group = F.lit(0)
    for made in range(1, topics):
        n = F.col("n").cast("double")
        sums = grid.withColumn("__group", group).groupBy("__group").agg(F.sum(n).alias("n"), *[F.sum(n * F.col(f)).alias(f"s{f}") for f in SCALES], *[F.sum(n * F.col(f) * F.col(f)).alias(f"q{f}") for f in SCALES])
        spread = [(-(r[f"q{f}"] - r[f"s{f}"] ** 2 / r["n"]), r["__group"], f, r["n"], r[f"s{f}"]) for r in sums.collect() for f in SCALES]  # a row for each group
        if not spread or min(spread)[0] >= 0:
            break
        _, split, scale, count, total = min(spread)
        group = F.when((group == split) & (F.col(scale) * count > total), made).otherwise(group)
    return group


def level_targets(cells: DataFrame, margin: Margin, total: float, fraction: float, passes: int = 40) -> DataFrame:
    """The margin's levels with the share of the tokens, the target and the target as far as it can be reached."""
    given = F.create_map(*[F.lit(x) for pair in margin.weights.items() for x in pair])[F.col(margin.column)] if margin.weights else F.lit(None).cast("double")
    own = F.sum("tokens") / total
    levels = staged(cells.groupBy(margin.column).agg(own.alias("share")).withColumn("given", given).withColumn("own", F.pow("share", F.lit(margin.power))), "levels")
    sums = levels.agg(F.sum("own").alias("all"), F.sum(F.when(F.col("given").isNull(), F.col("own"))).alias("others"), F.sum("given").alias("given")).first()
    left = 1 - (sums["others"] or 0.0) / (sums["all"] or 1.0)
    target = F.coalesce(F.col("given") * (left / (sums["given"] or 1.0)), F.col("own") / (sums["all"] or 1.0))
    aimed = levels.select(margin.column, "share", target.alias("target"), (F.col("share") / fraction).alias("most"))
    scale = 1.0
    for _ in range(passes):  # a pass for each time that more levels turn out to be whole
        over = F.lit(scale) * F.col("target") > F.col("most")
        row = aimed.agg(F.sum(F.when(over, F.col("most"))).alias("held"), F.sum(F.when(~over, F.col("target"))).alias("free")).first()
        new = (1 - (row["held"] or 0.0)) / row["free"] if row["free"] else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return staged(aimed.select(margin.column, "share", "target", F.least("most", F.lit(scale) * F.col("target")).alias("reachable")), "targets")


def with_level(cells: DataFrame, levels: DataFrame, column: str, **named: str) -> DataFrame:
    """cells with columns of their level, null equal to null."""
    other = levels.select(F.col(column).alias("__level"), *[F.col(v).alias(k) for k, v in named.items()])
    return cells.join(other, cells[column].eqNullSafe(other["__level"])).drop("__level")


def rake(cells: DataFrame, margins: tuple[Margin, ...] = MARGINS, fraction: float = FRACTION, rounds: int = ROUNDS, near: float = NEAR, few: int = FEW_CELLS) -> DataFrame:
    """cells (levels and tokens, all over 0) with `weight`: the shares of what is kept, raked to the margins' targets, none over what the cell holds.

    Every CHECKED rounds it is asked whether all levels are near their targets.
    """
    sizes = cells.agg(F.sum("tokens").cast("double").alias("t"), F.count("*").alias("n")).first()
    total, small = sizes["t"] or 1.0, sizes["n"] <= few
    now = cells.withColumn("weight", F.col("tokens") / total)
    for i, m in enumerate(margins):
        now = with_level(now, level_targets(cells, m, total, fraction), m.column, **{f"__target{i}": "reachable"})
    now = staged(now, "aimed")
    most = F.col("tokens") / total / fraction
    for r in range(rounds):
        if small and r % CHECKED == 0:
            now = now.coalesce(1)
        for i, m in enumerate(margins):
            raked = F.least(most, F.coalesce(F.try_divide(F.col("weight") * F.col(f"__target{i}"), F.col("__held")), F.lit(0.0)))
            if small:
                held = now.withColumn("__held", F.sum("weight").over(Window.partitionBy(m.column)))
            else:
                held = with_level(now, now.groupBy(m.column).agg(F.sum("weight").alias("held")), m.column, __held="held")
            now = held.withColumn("weight", raked).drop("__held")
            if not small:
                now = staged(now, "raked")
        if r % CHECKED == CHECKED - 1 or r == rounds - 1:
            now = staged(now, "raked") if small else now
            off = [now.groupBy(m.column).agg(F.sum("weight").alias("h"), F.first(f"__target{i}").alias("t")).select(F.coalesce(F.abs(F.try_divide("h", "t") - 1), F.lit(0.0)).alias("off")) for i, m in enumerate(margins)]
            if (reduce(DataFrame.unionByName, off).agg(F.max("off").alias("off")).first()["off"] or 0.0) <= near:
                break
    return now.select(*cells.columns, "weight", F.least(F.lit(1.0), F.col("weight") * fraction * total / F.col("tokens")).alias("probability"))


def margins_met(cells: DataFrame, raked: DataFrame, margins: tuple[Margin, ...] = MARGINS, fraction: float = FRACTION) -> DataFrame:
    """margin, level, target, reachable and expected: the shares that the levels should have, can have at most and will have of the tokens kept."""
    sums = cells.agg(F.sum("tokens").cast("double").alias("t")).first()["t"] or 1.0
    kept = raked.agg(F.sum(F.col("probability") * F.col("tokens")).alias("k")).first()["k"] or 1.0
    out = []
    for m in margins:
        held = raked.groupBy(m.column).agg((F.sum(F.col("probability") * F.col("tokens")) / kept).alias("expected"))
        told = with_level(level_targets(cells, m, sums, fraction), held, m.column, expected="expected")
        out.append(told.select(F.lit(m.column).alias("margin"), F.col(m.column).cast("string").alias("level"), "target", "reachable", "expected"))
    return reduce(DataFrame.unionByName, out)


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1, from the first 48 bits of a digest."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


FRESH = ("topic", "tokens", "weight", "probability", "sampled")


def told_documents(docs: DataFrame, keep: tuple[str, ...], topics: int = TOPICS) -> tuple[DataFrame, DataFrame]:
    """The columns `keep` of docs as __keep0, ..., with doc_id, the levels and tokens, written once; and the cells."""
    kept = [f"__keep{i}" for i in range(len(keep))]
    own = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], "doc_id", "source", "lang", F.col("text").alias("__text"), tokens_of(F.col("text")).alias("tokens"))
    read = staged(own.select(*kept, "doc_id", "source", "lang", "tokens", scales_of(F.col("__text"), F.col("tokens")).alias("__scales")), "read")
    read = read.select(*kept, "doc_id", "source", "lang", "tokens", *[F.col("__scales")[j].alias(f) for j, f in enumerate(SCALES)])
    grid = staged(read.where("tokens > 0").groupBy("source", "lang", *SCALES).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "grid")
    group = F.concat(F.lit("topic "), learned_topics(grid, topics).cast("string"))
    cells = staged(grid.withColumn("topic", group).groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "cells")
    return read.select(*kept, "doc_id", "source", "lang", F.when(F.col("tokens") == 0, "empty").otherwise(group).alias("topic"), "tokens"), cells


def mix(docs: DataFrame, margins: tuple[Margin, ...] = MARGINS, fraction: float = FRACTION, rounds: int = ROUNDS, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with topic, tokens, weight, probability and sampled, which replace columns of these names."""
    columns = tuple(c for c in (keep or docs.columns) if c not in FRESH)
    told, cells = told_documents(docs, columns)
    solved = staged(rake(cells, margins, fraction, rounds).select(*[F.col(c).alias(f"__{c}") for c in LEVELS], F.col("weight").alias("__w"), F.col("probability").alias("__p")), "raked")
    same = reduce(lambda a, b: a & b, [told[c].eqNullSafe(solved[f"__{c}"]) for c in LEVELS])
    probability = F.coalesce(F.col("__p"), F.lit(1.0))
    kept = [F.col(f"__keep{i}").alias(c) for i, c in enumerate(columns)]
    return told.join(solved, same, "left").select(*kept, "topic", "tokens", F.coalesce("__w", F.lit(0.0)).alias("weight"), probability.alias("probability"), (draw(F.col("doc_id")) < probability).alias("sampled"))
