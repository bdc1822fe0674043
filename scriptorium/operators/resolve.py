"""Resolving entities: cross-walks of identifiers, scored candidates, merged results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize_text
from .frames import first_per_key

#: Points of a candidate's score, and the least score of a match.
SAME_LABEL, NEAR_LABEL, SAME_ALIAS, NEAR_ALIAS, PER_TOKEN = 120, 70, 100, 60, 4
COUNTRY, ACADEMY, SCIENCE, ITEM, LEAST = 25, 8, 4, 1, 80


def near(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def score(names: Column, label: Column, description: Column, aliases: Column, country: Column, item_id: Column) -> Column:
    """Points of a candidate; texts are normalised, names and aliases are arrays of them."""
    texts = F.concat(F.array(label, description), aliases)
    tokens = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda t: t != ""))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)

    def of_name(name: Column) -> Column:
        by_label = F.when(label == name, SAME_LABEL).when(near(label, name), NEAR_LABEL).otherwise(0)
        by_alias = total(F.transform(aliases, lambda a: F.when(a == name, SAME_ALIAS).when(near(a, name), NEAR_ALIAS).otherwise(0)))
        by_token = total(F.transform(texts, lambda t: F.size(F.array_intersect(tokens(name), tokens(t))) * PER_TOKEN))
        return by_label + by_alias + by_token

    by_name = total(F.transform(F.filter(names, lambda n: n != ""), of_name))
    return (
        by_name
        + F.when((country != "") & F.contains(description, country), COUNTRY).otherwise(0)
        + F.when(F.contains(description, F.lit("academy")) | F.contains(label, F.lit("academy")), ACADEMY).otherwise(0)
        + F.when(F.contains(description, F.lit("science")) | F.contains(description, F.lit("technology")), SCIENCE).otherwise(0)
        + F.when(item_id.startswith("Q"), ITEM).otherwise(0)
    )


def search_queries(df: DataFrame, key: str, names: list[str], country: str | None = None, most: int = 3) -> DataFrame:
    """(key, query, position): up to `most` distinct names, each alone and with the country."""
    distinct = F.slice(F.array_distinct(F.filter(F.array(*[F.trim(F.col(n)) for n in names]), lambda x: x.isNotNull() & (x != ""))), 1, most)
    place = F.trim(F.coalesce(F.col(country), F.lit(""))) if country else F.lit("")
    asked = F.flatten(F.transform(distinct, lambda n: F.when(place != "", F.array(n, F.concat_ws(" ", n, place))).otherwise(F.array(n))))
    return df.select(key, F.posexplode(F.array_distinct(asked)).alias("position", "query"))


def best_candidates(entities: DataFrame, candidates: DataFrame, key: str, names: str, country: str, least: int = LEAST) -> DataFrame:
    """(key, id, score): of each entity's candidates the best of at least `least` points, the earliest of equals.

    entities: key, names array, country. candidates: key, id, label, description, aliases array, position.
    """
    unique = first_per_key(candidates, [key, "id"], ["position"])
    norm = unique.select(key, "id", "position", normalize_text(F.col("label")).alias("__l"), normalize_text(F.col("description")).alias("__d"), F.coalesce("aliases", F.array().cast("array<string>")).alias("__a"))
    alias = norm.select(key, "id", F.explode("__a").alias("x")).select(key, "id", normalize_text(F.col("x")).alias("x")).groupBy(key, "id").agg(F.collect_list("x").alias("__an"))
    own = entities.select(key, F.explode_outer(names).alias("n"), F.col(country).alias("__c")).select(key, normalize_text(F.col("n")).alias("n"), normalize_text(F.col("__c")).alias("__c"))
    own = own.groupBy(key, "__c").agg(F.collect_set("n").alias("__n"))
    joined = norm.join(alias, [key, "id"], "left").join(own, key)
    points = score(F.col("__n"), F.col("__l"), F.col("__d"), F.coalesce("__an", F.array().cast("array<string>")), F.col("__c"), F.col("id"))
    return first_per_key(joined.select(key, "id", "position", points.alias("score")).where(F.col("score") >= least), [key], [F.desc("score"), "position"]).select(key, "id", "score")


def cross_walk(df: DataFrame, walk: DataFrame, qid: str = "wikidata_id", title: str = "title", page: str = "dbpedia_url") -> DataFrame:
    """df with blank ids filled from a table (qid, title, dbpedia_url, dbpedia_exists), by qid, then title, then page.

    The table is read once for each distinct key and joined three times; a page counts only if it exists.
    """
    known = walk.select("qid", "title", F.when(F.col("dbpedia_exists"), F.col("dbpedia_url")).alias("page"))
    out = df
    for own, by in ((qid, "qid"), (title, "title"), (page, "page")):
        side = first_per_key(known.where(F.col(by).isNotNull()), [by], ["qid"]).select(*[F.col(c).alias(f"__{c}") for c in ("qid", "title", "page")])
        joined = out.join(side, out[own] == side[f"__{by}"], "left")
        fill = lambda c, new: F.coalesce(F.when(~is_blank(F.col(c)), F.col(c)), F.col(new)).alias(c)
        out = joined.select(*[fill(c, {qid: "__qid", title: "__title", page: "__page"}[c]) if c in (qid, title, page) else F.col(c) for c in df.columns])
    return out


def outcome(archived: Column, urls: Column, submitted: Column) -> Column:
    """What became of a site: its sitemap, a submission, a failure or nothing."""
    return F.when(archived & (F.size(urls) > 0), "sitemap").when(archived, "no_urls_found").when(submitted.isNull(), "none").when(submitted, "submitted").otherwise("failed")


def retrieval_outcome(website: Column, method: Column, urls: Column, saved: Column) -> tuple[Column, Column]:
    """(method, status) of fetching a site's urls: without a website the method is no_valid_url and the status failed; else no_urls_found,
    domain_extraction_failed where urls were found at an address without a host, save_failed or success."""
    no_site = F.coalesce(F.trim(website).isin("", "-"), F.lit(True))
    host = F.regexp_extract(F.coalesce(website, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]+)", 1)
    found = F.size(F.coalesce(urls, F.array().cast("array<string>"))) > 0
    status = F.when(no_site, "failed").when(~found, "no_urls_found").when(host == "", "domain_extraction_failed").when(F.coalesce(saved, F.lit(False)), "success").otherwise("save_failed")
    return F.when(no_site, "no_valid_url").otherwise(method), status


def geocoded(df: DataFrame, places: DataFrame, address: str = "address", fallback: str = "headquarters") -> DataFrame:
    """df with latitude, longitude and country of its address, else its headquarters, where the place is known."""
    asked = F.coalesce(F.when(~is_blank(F.col(address)), F.col(address)), F.col(fallback))
    told = places.select(F.col("place").alias("__p"), *[F.col(c).alias(f"__{c}") for c in ("latitude", "longitude", "country")])
    joined = df.withColumn("__ask", asked).join(told, F.col("__ask") == F.col("__p"), "left")
    fresh = lambda c: F.coalesce(F.when(F.col(f"__{c}").cast("string") != "N/A", F.col(f"__{c}")), F.col(c)).alias(c)
    return joined.select(*[fresh(c) if c in ("latitude", "longitude", "country") else F.col(c) for c in df.columns])
