"""Fetching over HTTP by a function that is handed in: retries, pages, crawls and look-ups.

A fetcher takes (url, params) and returns (status, text). Nothing here opens a connection itself, so tests
and offline runs hand in a function over fixtures. Keys are fetched once each: callers join the results back.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import same_host_links

Fetcher = Callable[[str, dict], tuple[int, str]]

#: Places where a site's sitemap usually is.
SITEMAP_PLACES = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml", "/wp-sitemap.xml"]


def with_retry(fetch: Fetcher, url: str, params: dict, tries: int = 5, wait: Callable[[int], float] = lambda i: min(2.0**i, 30.0), sleep: Callable[[float], None] = time.sleep) -> tuple[int, str]:
    """The first answer of status below 400; after the last try the error, or the last answer's status."""
    error: Exception | None = None
    answer = (0, "")
    for i in range(tries):
        try:
            answer, error = fetch(url, params), None
            if answer[0] < 400:
                return answer
        except Exception as e:
            error = e
        if i + 1 < tries:
            sleep(wait(i))
    if error:
        raise error
    raise RuntimeError(f"status {answer[0]} for {url}")


def fetched(keys: DataFrame, url: str, fetch: Fetcher, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, status, body) of each distinct url; failures have status 0 and no body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for u in batch[url]:
                try:
                    rows.append((u, *with_retry(fetch, u, {}, tries, lambda i: float(i + 1), sleep)))
                except Exception:
                    rows.append((u, 0, None))
            yield pd.DataFrame(rows, columns=["url", "status", "body"])

    return keys.select(url).where(F.col(url).isNotNull()).distinct().mapInPandas(run, "url string, status int, body string")


def exists(keys: DataFrame, url: str, fetch: Fetcher) -> DataFrame:
    return fetched(keys, url, fetch, tries=1).select("url", F.col("status").between(200, 399).alias("exists"))


def continued(fetch: Fetcher, url: str, params: dict, token: Callable[[dict], dict | None], items: Callable[[dict], list[dict]]) -> Iterator[dict]:
    """Items of a listing whose answers name what to ask for next."""
    more: dict | None = {}
    while more is not None:
        payload = json.loads(with_retry(fetch, url, {**params, **more})[1])
        yield from items(payload)
        more = token(payload)


def offset_pages(spark: SparkSession, fetch: Fetcher, url: str, params: dict, total: Callable[[str], int], page: int = 100, start: str = "startRecord", size: str = "maximumRecords") -> DataFrame:
    """(offset, body) of all pages of a query: the first tells the total, the others are fetched in parallel."""
    first = with_retry(fetch, url, {**params, start: 1, size: page})[1]
    offsets = list(range(1 + page, total(first) + 1, page))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(int(o), with_retry(fetch, url, {**params, start: int(o), size: page})[1]) for o in batch["offset"]], columns=["offset", "body"])

    head = spark.createDataFrame([(1, first)], "offset long, body string")
    if not offsets:
        return head
    rest = spark.createDataFrame([(o,) for o in offsets], "offset long").repartition(min(len(offsets), 64)).mapInPandas(run, "offset long, body string")
    return head.unionByName(rest)


def discovered(sites: DataFrame, site: str, fetch: Fetcher, places: list[str] = SITEMAP_PLACES) -> DataFrame:
    """(site, url, body): the first usual place at which a site has a sitemap."""
    tried = sites.select(site).distinct().select(site, F.posexplode(F.array(*[F.lit(p) for p in places])).alias("n", "place")).withColumn("url", F.concat(F.col(site), F.col("place")))
    answers = fetched(tried, "url", fetch, tries=1).where(F.col("status").between(200, 399) & F.col("body").contains("<loc"))
    found = tried.join(answers, "url")
    return found.groupBy(site).agg(F.min_by(F.struct("url", "body"), "n").alias("x")).select(site, "x.url", "x.body")


def crawl(sites: DataFrame, site: str, fetch: Fetcher, most_pages: int = 100, most_depth: int | None = None) -> DataFrame:
    """(site, url, depth) of pages of the same host, breadth first, the first most_pages of each site in order of depth and url; to any depth unless one is given."""
    from itertools import count

    from pyspark.sql import Window

    from ..operators.frames import cut

    seen = cut(sites.select(site, F.col(site).alias("url")).distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in count(1) if most_depth is None else range(1, most_depth + 1):
        pages = frontier.join(fetched(frontier, "url", fetch), "url").where(F.col("body").isNotNull())
        links = pages.select(site, F.explode(same_host_links(F.col("body"), F.col("url"))).alias("url")).distinct()
        fresh = links.join(seen, [site, "url"], "left_anti").withColumn("depth", F.lit(depth))
        order = Window.partitionBy(site).orderBy("depth", "url")
        both = cut(seen.unionByName(fresh).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most_pages).drop("__n"))
        frontier, seen = both.where(F.col("depth") == depth), both
        if frontier.isEmpty():
            break
    return seen
