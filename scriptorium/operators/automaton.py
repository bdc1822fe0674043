"""Many parts looked for at once: an Aho-Corasick automaton of them, run over texts in Arrow batches."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import staged

#: Characters of parts that one automaton holds, counted first: 32 bytes each, at most, in a Python worker. More are looked for in further passes.
AUTOMATON_CHARS = 1 << 24


def finder(spark: SparkSession, parts: list[str]) -> Callable[[Column], Column]:
    """A column function: whether a text contains one of the parts. A Python worker builds the automaton once and keeps the last one."""
    sent, name = spark.sparkContext.broadcast(parts), uuid.uuid4().hex

    @F.pandas_udf("boolean")
    def found(texts: pd.Series) -> pd.Series:
        kept = sys.modules.setdefault("scriptorium automaton of this worker", types.ModuleType("automaton")).__dict__.setdefault("kept", {})
        if name not in kept:
            import ahocorasick

            kept.clear()
            kept[name] = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for part in sent.value:
                kept[name].add_word(part)
            kept[name].make_automaton()
        search = kept[name].iter
        return pd.Series([x is not None and next(search(x), None) is not None for x in texts], dtype=bool)

    return found


def contains_any_semi(df: DataFrame, text: str, parts: DataFrame, part: str, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Rows whose lower-cased text contains one of the parts.

    A pass reads each text once, whatever the number of parts, and leaves no rows but those found. An empty part is in every text; null texts and parts
    are in none.
    """
    low = F.lower(F.col(text))
    told = parts.select(F.col(part).alias("__part")).where("__part is not null").distinct()
    size = told.agg(F.sum(F.length("__part")).alias("chars"), F.max(F.col("__part") == "").alias("empty"), F.count("*").alias("n")).first()
    if size["empty"]:
        return df.where(low.isNotNull())
    if not size["n"]:
        return df.limit(0)
    passes = -(-size["chars"] // automaton_chars)
    if passes == 1:
        return df.where(finder(df.sparkSession, [r["__part"] for r in told.collect()])(low))
    dealt = staged(told.withColumn("__pass", F.pmod(F.xxhash64("__part"), F.lit(passes))), "parts")
    open_, hits = staged(df.select(low.alias("__text")).where("__text is not null").distinct(), "texts"), []
    for k in range(passes):
        some = [r["__part"] for r in dealt.where(F.col("__pass") == k).select("__part").collect()]
        if some:
            told_of = staged(open_.withColumn("__hit", finder(df.sparkSession, some)(F.col("__text"))), "texts")
            hits.append(told_of.where("__hit").drop("__hit"))
            open_ = told_of.where("not __hit").drop("__hit")
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    return df.join(found, low == F.col("__text"), "left_semi")
