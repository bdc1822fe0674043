"""Columns that hold several values in one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import link_title, plain_title, squeeze, strip


def split_values(c: Column, pattern: str) -> Column:
    """Stripped parts that aren't empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), strip), lambda x: x != "")


def subject_codes(c: Column) -> Column:
    """The first three-digit code of each part of a text that was cleaned (text.clean_text) in a column of its own."""
    codes = F.transform(split_values(c, "[;|,]"), lambda p: F.regexp_extract(p, r"\b(\d{3})\b", 1))
    return F.filter(codes, lambda x: x != "")


def bodies(c: Column) -> Column:
    """Corporate bodies, lower case and distinct, of a text that was cleaned in a column of its own."""
    return F.array_distinct(F.transform(split_values(c, "[;|]"), F.lower))


def related_titles(c: Column) -> Column:
    """Titles between slashes, normalised, in order and distinct; dashes are none."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "/"), squeeze), lambda x: ~x.isin("", "-", "—"))
    return F.array_distinct(F.filter(F.transform(parts, plain_title), lambda x: x != ""))


def former_and_later(former_later: Column) -> tuple[Column, Column]:
    """The texts on either side of the first slash of a cleaned text; both null without one."""
    s = former_later
    at = F.instr(s, "/")
    return F.when(at > 0, F.substr(s, F.lit(1), at - 1)), F.when(at > 0, F.substr(s, at + 1))


def titles_in(part: Column) -> Column:
    """One title from each part of a text split at ';' and '|', as rows may hold; explode before normalising."""
    return F.split(F.coalesce(part, F.lit("")), "[;|]")


def joined_set(c: Column, by: str = " | ") -> Column:
    """An aggregate: distinct values that aren't null, sorted, in one text."""
    return F.array_join(F.array_sort(F.collect_set(c)), by)


__all__ = ["bodies", "former_and_later", "joined_set", "link_title", "related_titles", "split_values", "subject_codes", "titles_in"]
