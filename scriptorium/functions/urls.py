"""URLs, links and sitemaps as Column expressions."""

from __future__ import annotations

from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import or_empty, strip

#: Endings of files that aren't pages.
NOT_PAGES = [".js", ".css", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".pdf", ".woff", ".woff2", ".ttf", ".eot"]
URL_IN_TEXT = r"https?://[^\s<>\"'\)]+"
LOC = r"(?i)<loc[^>]*>([^<]+)</loc>"


def domain(url: Column) -> Column:
    """What stands between '://' and the path; empty if there is no scheme."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def domain_or_null(url: Column) -> Column:
    """The domain, of urls without a scheme too; null for '-' and blanks."""
    u = or_empty(url)
    whole = F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*://"), u).otherwise(F.concat(F.lit("http://"), u))
    return F.when(~u.isin("", "-"), F.nullif(domain(whole), F.lit("")))


@pandas_udf(StringType())
def percent_decode(s: pd.Series) -> pd.Series:
    """Plus signs stay, and malformed escapes stay as they are."""
    return s.map(unquote, na_action="ignore")


@pandas_udf(StringType())
def absolute(base: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b or "", u) if u is not None else None for b, u in zip(base, url, strict=True)])


def path(url: Column) -> Column:
    """Between the domain and '?' or '#'."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def cut_query(c: Column) -> Column:
    """Without what follows the first '?', '&' or '#'."""
    return F.regexp_replace(c, r"[?&#].*", "")


def segments(path_text: Column, endings: list[str] = NOT_PAGES) -> Column:
    """Names along a path, without files that aren't pages.

    Where a path may hold escapes, select percent_decode(path(url)) as a column of its own before.
    """
    parts = F.transform(F.split(F.coalesce(path_text, F.lit("")), "/"), strip)
    named = F.transform(F.filter(parts, lambda x: x != ""), cut_query)
    pattern = "(?i)(" + "|".join(e.replace(".", r"\.") for e in endings) + ")$"
    return F.filter(named, lambda x: ~x.rlike(pattern))


def parent_pairs(names: Column, root: str = "Homepage") -> Column:
    """Array of (parent, name): each name with the one before it, the first with the root."""
    return F.transform(names, lambda s, i: F.struct(F.when(i == 0, F.lit(root)).otherwise(F.get(names, i - 1)).alias("parent"), s.alias("name")))


def relative(url: Column) -> Column:
    """Without scheme and domain, and without a trailing '/'; the query stays."""
    return F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), "/+$", "")


def is_page(url: Column, anywhere: bool = False, endings: list[str] = NOT_PAGES) -> Column:
    """Whether no ending of a file occurs at the end (or anywhere) of the url."""
    pattern = "(?i)(" + "|".join(e.replace(".", r"\.") for e in endings) + ")" + ("" if anywhere else "$")
    return ~url.rlike(pattern)


def is_sane(url: Column) -> Column:
    return url.rlike("^https?://") & (F.length(url) > 10)


def _sane(urls: Column) -> Column:
    return F.filter(F.transform(urls, strip), is_sane)


def harvest(content: Column) -> Column:
    """Distinct urls of <loc> elements and of running text, without leftovers of markup."""
    found = F.concat(F.regexp_extract_all(content, F.lit(LOC), F.lit(1)), F.regexp_extract_all(content, F.lit(URL_IN_TEXT), F.lit(0)))
    bare = F.transform(_sane(found), lambda u: F.regexp_replace(F.regexp_replace(u, r"<![^\[]*>", ""), r"&[^;]*;", ""))
    return F.array_sort(F.array_distinct(bare))


def harvest_lines(content: Column) -> Column:
    """Distinct urls line by line, for badly damaged files."""
    lines = F.filter(F.split(content, "\n"), lambda x: x.contains("http"))
    both = F.transform(lines, lambda x: F.concat(F.regexp_extract_all(x, F.lit("(?i)" + URL_IN_TEXT), F.lit(0)), F.regexp_extract_all(x, F.lit(LOC), F.lit(1))))
    return F.array_sort(F.array_distinct(_sane(F.flatten(both))))


def sitemap_urls(content: Column, standard: Column | None = None) -> Column:
    """(urls, parsing_method): the first way of reading that finds any: standard XML, patterns, lines, bare text."""
    ways = [("standard", F.coalesce(standard, F.array().cast("array<string>"))) if standard is not None else None, ("regex", harvest(content)), ("line_by_line", harvest_lines(content)), ("fallback", _sane(F.regexp_extract_all(content, F.lit(URL_IN_TEXT), F.lit(0))))]
    chosen = F.lit(None).cast("struct<urls:array<string>,parsing_method:string>")
    for name, urls in reversed([w for w in ways if w]):
        chosen = F.when(F.size(urls) > 0, F.struct(urls.alias("urls"), F.lit(name).alias("parsing_method"))).otherwise(chosen)
    return F.coalesce(chosen, F.struct(F.array().cast("array<string>").alias("urls"), F.lit("failed").alias("parsing_method")))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="(.*?)"'), F.lit(1))


def same_host_links(html: Column, base: Column) -> Column:
    """Distinct absolute links of a page to its own host; relative ones are resolved against the host."""
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    whole = F.transform(hrefs(html), lambda h: F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), h).when(h.startswith("/"), F.concat(host, h)).otherwise(F.concat(host, F.lit("/"), h)))
    return F.array_sort(F.array_distinct(F.filter(whole, lambda h: F.startswith(h, host) & (host != ""))))


def emails(html: Column, none: str = "") -> Column:
    """Addresses of mailto: links, distinct and sorted, joined by ', '; what follows '?' isn't part of them."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?i)mailto:([^\"'?>\s]+)"), F.lit(1))))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(F.lit(none))


def title_of_entity_url(url: Column) -> Column:
    """The last path segment, decoded, underscores as spaces; null if blank."""
    bare = F.regexp_replace(or_empty(url), r"[?#].*$", "")
    return F.nullif(strip(F.translate(percent_decode(F.regexp_extract(bare, "([^/]*)/?$", 1)), "_", " ")), F.lit(""))


def entity_url(base: str, title: Column) -> Column:
    return F.concat(F.lit(base), F.translate(title, " ", "_"))
