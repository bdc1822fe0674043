"""The studies end to end: rates of hosts, survival of journals, their dynamics, structure of sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.multivalue import subject_codes
from ..functions.text import clean_text, or_empty
from ..functions.urls import NOT_PAGES, cut_query, domain, parent_pairs, path, percent_decode, relative, segments
from ..operators import academies, cluster, frames, graph, panels, rates, sets, survival

PERIODICAL = "Periodical (Journal)"


def hosted_rates(roster: DataFrame, countries: DataFrame, hosts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rates of academies with a journal, by development and by field, each with Wilson's interval."""
    table = academies.academy_table(roster, countries, hosts)
    by_class = rates.rates(table, "dev_group", "hosted", ["Developed", "Developing"])
    named = table.withColumn("field", F.when(F.col("is_engineering") == 1, "Engineering").otherwise("Non-engineering"))
    return by_class, rates.rates(named, "field", "hosted", ["Engineering", "Non-engineering"])


def periodicals(journals: DataFrame) -> DataFrame:
    return journals.where(or_empty(F.col("Type of publication")) == PERIODICAL) if "Type of publication" in journals.columns else journals


def lineages_with_groups(journals: DataFrame, hosted: DataFrame, attributes: DataFrame, groups: list[str]) -> DataFrame:
    """Lineages of journals, with the group of their hosting academies for each of the attributes named."""
    frames.require_columns(journals, ["ZDB-ID", "Title", "Published", "Former/later titles"], "the journals")
    told = graph_cut(panels.lineages(periodicals(journals).withColumn("ZDB-ID", F.trim("ZDB-ID")), "ZDB-ID", "Title", "Former/later titles", "Published"))
    members = told.select("lineage", F.explode("members").alias("zdb_id")).join(hosted, "zdb_id", "left").select("lineage", "acad_id").distinct()
    for g in groups:
        told = told.join(panels.lineage_groups(members, attributes.select("acad_id", g), "lineage", "acad_id", g), "lineage", "left").na.fill("Unknown", [g])
    return told


def graph_cut(df: DataFrame) -> DataFrame:
    return frames.cut(df)


def journal_survival(journals: DataFrame, hosted: DataFrame, attributes: DataFrame, tau: int = 100, replicates: int = 800) -> tuple[DataFrame, DataFrame]:
    """(lineages, summary): by engineering and by development, the two clean groups of each compared."""
    told = lineages_with_groups(journals, hosted, attributes, ["eng_group", "dev_group"])
    compare = lambda name, g, a, b: survival.two_group_summary(told, name, g, a, b, "start_year", tau, replicates=replicates)
    summary = compare("Engineering vs non-engineering", "eng_group", "Engineering", "Non-engineering").unionByName(compare("Developed vs developing", "dev_group", "Developed", "Developing"))
    return told, summary


def journal_dynamics(journals: DataFrame, labels: DataFrame | None = None, k: int = 18) -> dict[str, DataFrame]:
    """The year panel, counts and yearly activity of subject codes (the k largest and Other), and families of journals.

    labels: (code, label), optional.
    """
    own = periodicals(journals)
    spans = panels.panel_spans(own, "Published", "ZDB-ID")
    out = {"panel": panels.year_panel(spans, "ZDB-ID")}
    if "DDC subject groups" in own.columns:
        coded = own.select("ZDB-ID", clean_text(F.col("DDC subject groups")).alias("__s")).select("ZDB-ID", subject_codes(F.col("__s")).alias("codes"))
        counts = frames.multivalue_counts(coded, "ZDB-ID", "codes").withColumnsRenamed({"value": "code", "n_values": "n_records", "n_records": "n_journals"})
        out["codes"] = counts.join(labels, "code", "left") if labels is not None else counts
        active = panels.active_by_code(spans, coded.select("ZDB-ID", F.explode("codes").alias("code")), "ZDB-ID", "code")
        out["active"] = frames.top_and_other(active, "code", "active", "year", k)
    if {"Title", "Former/later titles", "Corporate body"} <= set(own.columns):
        links = panels.title_links_checked(own, "ZDB-ID", "Title", "Former/later titles", "Corporate body")
        out["families"] = panels.families(own, links, "ZDB-ID", "Title")
        out["gantt"] = gantt(own, links, spans)
    return out


def gantt(journals: DataFrame, links: DataFrame, spans: DataFrame) -> DataFrame:
    """(position, id, title, start, end) of the largest family's members; the smaller name of equals."""
    tied = graph.components(links)
    largest = tied.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    members = tied.join(largest, "component", "left_semi").select(F.col("node").alias("ZDB-ID"))
    own = panels.spans_by_id(spans, "ZDB-ID").join(members, "ZDB-ID").join(journals.select("ZDB-ID", "Title").dropDuplicates(["ZDB-ID"]), "ZDB-ID")
    from pyspark.sql import Window

    order = Window.orderBy("start", F.desc(F.col("end") - F.col("start")), "Title", "ZDB-ID")  # one family's members
    return own.select(F.row_number().over(order).alias("position"), F.col("ZDB-ID").alias("id"), F.col("Title").alias("title"), "start", "end")


def url_hierarchy(urls: DataFrame, url: str = "loc", endings: list[str] = NOT_PAGES) -> DataFrame:
    """(domain, url, parent, name), distinct."""
    told = urls.select(F.col(url).alias("url"), percent_decode(path(F.col(url))).alias("__p"))
    each = told.select(domain(F.col("url")).alias("domain"), "url", F.explode(parent_pairs(segments(F.col("__p"), endings))).alias("e"))
    return each.select("domain", "url", "e.parent", "e.name").distinct()


def menu_hierarchy(menu: DataFrame) -> DataFrame:
    """(site_name, hypernym, hyponym) from pages (site_name, loc, Response): categories of pages whose path begins with another's."""
    paths = menu.where(F.col("Response").isNotNull()).select("site_name", relative(F.col("loc")).alias("path"), "Response").distinct()
    pairs = frames.prefix_pairs(paths, "site_name", "path")
    up = paths.select("site_name", F.col("path").alias("parent"), F.col("Response").alias("hypernym"))
    down = paths.select("site_name", F.col("path").alias("child"), F.col("Response").alias("hyponym"))
    return pairs.join(up, ["site_name", "parent"]).join(down, ["site_name", "child"]).select("site_name", "hypernym", "hyponym").distinct()


def site_hierarchy(urls: DataFrame, sites: DataFrame, tags: DataFrame, menu: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(sitedomain, hypernym, hyponym): url and menu hierarchies of the listed sites, over known tags, by the dictionary terms (k, v, n).

    urls: site_name, loc, sitedomain. sites: sitedomain. tags: tag.
    """
    own = urls.join(sites.select("sitedomain").distinct(), "sitedomain", "left_semi")
    pairs = url_hierarchy(own).join(sites.select(F.col("sitedomain").alias("domain")).distinct(), "domain", "left_semi")
    known = tags.select(F.col("tag").alias("__t")).where("__t is not null").distinct()
    ends = pairs.select("*", F.explode(F.array_distinct(F.array("name", "parent"))).alias("__t")).join(known, "__t", "left_semi").drop("__t").distinct()
    by_url = ends.select(F.col("domain").alias("sitedomain"), cut_query(F.col("parent")).alias("hypernym"), cut_query(F.col("name")).alias("hyponym")).where("hyponym <> ''")
    names = own.select("site_name", "sitedomain").distinct()
    by_menu = menu_hierarchy(menu).join(names, "site_name").select("sitedomain", "hypernym", "hyponym")
    both = frames.union_distinct(by_url, by_menu)
    if terms is not None:
        last = frames.last_wins(terms, "k", "v", "n")
        both = frames.mapped(frames.mapped(both, "hypernym", last, "k", "v"), "hyponym", last, "k", "v")
    return frames.drop_blank(both, ["hypernym", "hyponym"]).distinct()


def site_structure(hierarchy: DataFrame, taxonomy: DataFrame, k: int = 3) -> dict[str, DataFrame]:
    """Scores, similarities, clusters, distinctive pairs and coverage of sites (sitedomain, hypernym, hyponym) over a taxonomy (hypernym, hyponym)."""
    edges = taxonomy.select(F.col("hypernym").alias("parent"), F.col("hyponym").alias("child")).distinct()
    closed = frames.cut(graph.with_missing_ancestors(hierarchy, edges).join(taxonomy.distinct(), ["hypernym", "hyponym"], "left_semi").select("sitedomain", "hypernym", "hyponym").distinct())
    item = ["hypernym", "hyponym"]
    pairs = sets.overlaps(closed, "sitedomain", item)
    similar = frames.cut(sets.jaccard(pairs))
    groups = frames.cut(cluster.ward_clusters(closed, similar, "sitedomain", "jaccard", k))
    lift = sets.distinctiveness(closed.join(groups.select("sitedomain", "cluster"), "sitedomain"), "cluster", item)
    return {
        "scores": sets.coverage(closed, taxonomy.distinct(), "sitedomain", item),
        "jaccard": similar,
        "cosine": sets.cosine(pairs),
        "clusters": groups,
        "cluster_means": sets.block_means(similar, groups, "sitedomain", "cluster", "jaccard"),
        "imitation": sets.imitation_innovation(closed, "sitedomain", item),
        "distinctive": frames.top_per_group(lift, ["cluster"], [F.desc("lift"), *item], 5),
        "least_distinctive": frames.top_per_group(lift, ["cluster"], ["lift", *item], 5),
        "first_level": sets.first_level_coverage(closed, groups.select("sitedomain", "cluster"), "sitedomain", "cluster"),
    }
