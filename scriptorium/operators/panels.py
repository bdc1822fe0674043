"""Panels over years: what is active, born and gone, and lineages of journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.multivalue import bodies, former_and_later, joined_set, related_titles, titles_in
from ..functions.text import clean_text, link_title, plain_title
from ..functions.years import HORIZON, published_span, stated_years
from .frames import cut, first_per_key
from .graph import components


def spans_by_id(spans: DataFrame, key: str) -> DataFrame:
    """One span for each id: least start, greatest end, open if any is."""
    return spans.where("start is not null").groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.bool_or("censored").alias("censored"))


def active_by(spans: DataFrame, by: list[str], first: int | None = None, last: int | None = None) -> DataFrame:
    """(by, year, active) for every year of a dense axis: +1 at a start, -1 after an end, accumulated."""
    if first is None or last is None:
        edge = spans.agg(F.min("start").alias("a"), F.max("end").alias("b")).first()
        first, last = edge["a"], edge["b"]
    if first is None:
        return spans.select(*by, F.lit(0).alias("year"), F.lit(0).cast("long").alias("active")).limit(0)
    deltas = spans.select(*by, F.col("start").alias("year"), F.lit(1).alias("delta")).union(spans.select(*by, F.col("end") + 1, F.lit(-1)))
    deltas = deltas.groupBy(*by, "year").agg(F.sum("delta").alias("delta"))
    keys = spans.select(*by).distinct() if by else spans.sparkSession.range(1).select()
    grid = keys.select(*by, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"), F.lit(0).cast("long").alias("delta"))
    both = deltas.unionByName(grid).groupBy(*by, "year").agg(F.sum("delta").alias("delta"))
    sofar = F.sum("delta").over(Window.partitionBy(*by).orderBy("year"))
    return both.withColumn("active", sofar).where((F.col("year") >= first) & (F.col("year") <= last)).select(*by, "year", "active")


def year_panel(spans: DataFrame, key: str) -> DataFrame:
    """(year, active, births, deaths, net) over unique ids; the open ones don't die."""
    own = spans_by_id(spans, key)
    births = own.groupBy(F.col("start").alias("year")).agg(F.count("*").alias("births"))
    deaths = own.where("not censored").groupBy(F.col("end").alias("year")).agg(F.count("*").alias("deaths"))
    panel = active_by(own, []).join(births, "year", "left").join(deaths, "year", "left").na.fill(0, ["births", "deaths"])
    return panel.select("year", "active", "births", "deaths", (F.col("births") - F.col("deaths")).alias("net"))


def active_by_code(spans: DataFrame, codes: DataFrame, key: str, code: str) -> DataFrame:
    """Active ids by code and year; an id counts once for each of its codes."""
    own = codes.select(key, code).distinct().join(spans_by_id(spans, key), key)
    edge = own.agg(F.min("start").alias("a"), F.max("end").alias("b")).first()
    return active_by(own, [code], edge["a"], edge["b"])


def title_links(journals: DataFrame, key: str, title: str, related: str) -> DataFrame:
    """(src, dst): journals tied to every journal whose title is among their related ones."""
    named = journals.select(F.col(key).alias("dst"), plain_title(F.col(title)).alias("t")).where("t <> ''")
    asked = journals.select(F.col(key).alias("src"), F.explode(related_titles(F.col(related))).alias("t"))
    return asked.join(named.hint("merge"), "t").where("src <> dst").select("src", "dst").distinct()


def title_links_checked(journals: DataFrame, key: str, title: str, related: str, body: str) -> DataFrame:
    """(src, dst): as title_links, but a title that several journals have ties only those that share a body.

    Titles of several journals meet by title and body, so only pairs that are tied are made; each under the first body that it shares, so that
    none needs to be looked for twice, but those with journals that have several titles.
    """
    journals = journals.select(F.col(key).alias("id"), link_title(F.col(title)).alias("t"), clean_text(F.col(body)).alias("body"), clean_text(F.col(related)).alias("related"))
    journals = cut(journals.select("id", "t", bodies(F.col("body")).alias("bodies"), "related"))
    # A journal's bodies are those of all its rows: of the ones under a title where it is named, of any where it asks.
    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("bodies"))))
    named = journals.where("t <> ''").groupBy("t", F.col("id").alias("dst")).agg(every.alias("bodies"), F.count("*").alias("n"))
    many = named.groupBy("t").agg(F.sum("n").alias("many"))
    titles = named.groupBy("dst").agg((F.count("*") > 1).alias("several"))
    named = cut(named.join(many, "t").join(titles, "dst"))
    former, later = former_and_later(F.col("related"))
    asked = journals.select(F.col("id").alias("src"), F.explode(F.concat(titles_in(former), titles_in(later))).alias("raw"))
    asked = asked.select("src", link_title(F.col("raw")).alias("t")).where("t <> ''").distinct()
    asked = cut(asked.join(journals.groupBy(F.col("id").alias("src")).agg(every.alias("mine")), "src"))
    only = asked.join(named.where("many = 1"), "t").where("src <> dst").select("src", "dst", "several")
    theirs = named.where("many > 1").select("t", "dst", "bodies", "several", F.explode("bodies").alias("body"))
    shared = asked.select("src", "t", "mine", F.explode("mine").alias("body")).join(theirs, ["t", "body"]).where("src <> dst")
    first = (F.size("mine") == 1) | (F.size("bodies") == 1) | (F.array_min(F.array_intersect("mine", "bodies")) == F.col("body"))
    pairs = only.union(shared.where(first).select("src", "dst", "several"))
    if titles.where("several").isEmpty():
        return pairs.select("src", "dst")
    return pairs.where("not several").select("src", "dst").union(pairs.where("several").select("src", "dst").distinct())


def families(journals: DataFrame, links: DataFrame, key: str, title: str) -> DataFrame:
    """(component, size, ids, titles) of journals tied together."""
    nodes = first_per_key(journals.select(F.col(key).alias("node"), F.col(title).alias("title")), ["node"], ["title"])
    tied = nodes.join(components(links).hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return tied.groupBy("component").agg(F.count("*").alias("size"), joined_set(F.col("node")).alias("ids"), joined_set(F.col("title")).alias("titles"))


def lineages(journals: DataFrame, key: str, title: str, related: str, published: str, horizon: int = HORIZON) -> DataFrame:
    """(lineage, members, n_titles, start_year, end_year, event, duration): components of title links as survival subjects.

    A lineage is open if a member is, or if no member has an end; it then ends at the horizon.
    """
    unique = first_per_key(journals, [key], [F.col(c).cast("string") for c in journals.columns if c != key])
    parsed = unique.withColumn("__y", stated_years(F.col(published)))
    tied = parsed.select(F.col(key).alias("node"), "__y").join(components(title_links(unique, key, title, related)).hint("merge"), "node", "left")
    folded = tied.groupBy(F.coalesce("component", "node").alias("lineage")).agg(
        F.array_sort(F.collect_set("node")).alias("members"), F.count("*").alias("n_titles"), F.min("__y.start").alias("start_year"), F.max("__y.end").alias("last"), F.bool_or("__y.censored").alias("open")
    )
    is_open = F.col("open") | F.col("last").isNull()
    told = folded.withColumn("end_year", F.when(is_open, F.lit(horizon)).otherwise(F.col("last"))).withColumn("event", (~is_open).cast("int"))
    return told.withColumn("duration", F.col("end_year") - F.col("start_year") + 1).where("start_year is not null and duration >= 1").drop("last", "open")


def lineage_groups(members: DataFrame, attributes: DataFrame, lineage: str, member: str, group: str) -> DataFrame:
    """(lineage, group): Unknown without a known group, the only one, or Mixed."""
    known = F.collect_set(F.when(F.col(group) != "Unknown", F.col(group)))
    return members.join(attributes, member, "left").groupBy(lineage).agg(known.alias("__g")).select(
        lineage, F.when(F.size("__g") == 0, "Unknown").when(F.size("__g") == 1, F.get("__g", F.lit(0))).otherwise("Mixed").alias(group)
    )


def panel_spans(journals: DataFrame, published: str, *keep: str) -> DataFrame:
    return journals.select(*keep, published_span(F.col(published)).alias("__s")).select(*keep, "__s.*")
