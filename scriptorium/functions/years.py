"""Spans of years from publication statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text

HORIZON = 2025
YEAR = r"(1[5-9]\d{2}|20\d{2}|21\d{2})"


def _years(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))


def _span(first: Column, last: Column, is_open: Column) -> Column:
    return F.struct(first.alias("start"), last.alias("end"), F.coalesce(is_open, F.lit(False)).alias("censored"))


def published_span(c: Column, horizon: int = HORIZON, clean: bool = True) -> Column:
    """(start, end, censored): first and last year; a text that ends in 'YYYY-' is open to the horizon; end is at least start.

    clean=False skips the Unicode cleaning for texts known to be plain, and so stays within the JVM.
    """
    s = clean_text(c) if clean else F.coalesce(c, F.lit(""))
    years = _years(s, rf"\b{YEAR}\b")
    start = F.try_element_at(years, F.lit(1))
    is_open = (F.size(years) > 0) & s.rlike(rf"\b{YEAR}\s*-\s*$")
    return _span(start, F.greatest(start, F.when(is_open, F.lit(horizon)).otherwise(F.try_element_at(years, F.lit(-1)))), is_open)


def stated_years(c: Column) -> Column:
    """(start, end, censored) as stated: also open for '[YYYY]-' and 'YYYY?-', end neither replaced nor raised."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    years = _years(s, YEAR)
    is_open = (F.size(years) > 0) & s.rlike(r"(\d{4}|\[\d{4}\]|\d{4}\?)\s*-\s*$")
    return _span(F.try_element_at(years, F.lit(1)), F.try_element_at(years, F.lit(-1)), is_open)


def century(year: Column) -> Column:
    """15th to 21st, for the years 1401 to 2100."""
    n = (F.floor((year.try_cast("int") - 1) / 100) + 1).cast("int")
    return F.when((n >= 15) & (n <= 20), F.concat(n.cast("string"), F.lit("th"))).when(n == 21, "21st")
