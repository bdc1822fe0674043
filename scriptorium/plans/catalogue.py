"""Every query of the library by name, over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import multivalue, stats, text, urls, years
from ..operators import academies, cluster, frames, graph, panels, rates, resolve, scans, sets, survival
from ..sources.readers import archive_listing, marc_bodies, marc_values, table, table_rows

FLAGSHIP = "km_curve"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- rates and counts

Z = stats.Z95


@query(f"""
with g as (select lang, cast(sum(coalesce(quality, 0)) as bigint) as k, count(*) as n
           from documents left join labels using (doc_id) group by lang),
     p as (select *, cast(k as double) / n as rate from g)
select lang, k, n, round(rate, 9) as rate,
  round(greatest(0.0, (rate + {Z}*{Z}/(2*n) - {Z}*sqrt(rate*(1-rate)/n + {Z}*{Z}/(4.0*n*n))) / (1 + {Z}*{Z}/n)), 9) as low,
  round(least(1.0, (rate + {Z}*{Z}/(2*n) + {Z}*sqrt(rate*(1-rate)/n + {Z}*{Z}/(4.0*n*n))) / (1 + {Z}*{Z}/n)), 9) as high
from p""")
def rate_wilson_by_group(spark: SparkSession, d: str) -> DataFrame:
    flagged = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").na.fill(0, ["quality"])
    told = rates.rates(flagged, "lang", "quality")
    return told.select("lang", "k", "n", *[F.round(c, 9).alias(c) for c in ("rate", "low", "high")])


@query("""
with l(lang) as (values ('en'), ('fr'), ('it'))
select l.lang, count(distinct d.doc_id) as n from l left join documents d on d.lang = l.lang group by l.lang""")
def counts_of_listed(spark: SparkSession, d: str) -> DataFrame:
    return frames.counts_of(table(spark, d, "documents"), "lang", ["en", "fr", "it"]).select("lang", "n")


@query("select event_type, count(*) as n from events group by event_type")
def value_counts_status(spark: SparkSession, d: str) -> DataFrame:
    return frames.value_counts(table(spark, d, "events"), "event_type")


@query("""
select c_mktsegment as segment, """ + ", ".join(f"count(*) filter (where year(o_orderdate) = {y}) as y{y}" for y in range(1995, 2002)) + """
from orders join customer on o_custkey = c_custkey group by c_mktsegment""")
def crosstab_year(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    told = joined.select(F.col("c_mktsegment").alias("segment"), F.concat(F.lit("y"), F.year("o_orderdate")).alias("year"))
    return frames.crosstab(told, "segment", "year", [f"y{y}" for y in range(1995, 2002)])


@query("""
select case when y between 1401 and 2000 then cast((y - 1) // 100 + 1 as varchar) || 'th' when y between 2001 and 2100 then '21st' end as century, count(*) as n
from (select p_size * 20 + 1380 as y from part) group by 1""")
def century_bins(spark: SparkSession, d: str) -> DataFrame:
    founded = table(spark, d, "part").select((F.col("p_size") * 20 + 1380).cast("string").alias("y"))
    return founded.groupBy(years.century(F.col("y")).alias("century")).agg(F.count("*").alias("n"))


TOKENS = "(select p_partkey, unnest(list_filter(string_split(p_name, ' '), lambda x: x <> '')) as token from part)"


@query(f"""
select token as value, count(*) as n_values, count(distinct p_partkey) as n_records,
  round(count(distinct p_partkey) / (select cast(count(distinct p_partkey) as double) from part), 9) as share
from {TOKENS} group by token""")
def multivalue_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", multivalue.split_values(F.col("p_name"), " ").alias("tokens"))
    return frames.multivalue_counts(parts, "p_partkey", "tokens").withColumn("share", F.round("share", 9))


@query("select value, n_values from (select p_type as value, count(*) as n_values from part group by 1) order by n_values desc, value limit 5")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n_values")).orderBy(F.desc("n_values"), "value").limit(5)


@query("""
with l as (select p_brand as code, year(l_shipdate) as year, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1, 2),
     best as (select code as b from l group by code order by sum(n) desc, code limit 18)
select year, coalesce(b, 'Other') as code, cast(sum(n) as bigint) as n from l left join best on code = b group by 1, 2""")
def topk_other(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counted = lines.groupBy(F.col("p_brand").alias("code"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    return frames.top_and_other(counted, "code", "n", "year", 18)


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts, event_id) as r from events) where r = 1")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    return frames.first_per_key(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("select c_custkey as custkey, string_agg(distinct p_brand, ' | ' order by p_brand) as brands from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey group by 1")
def set_union_listagg(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("o_custkey").alias("custkey")).agg(multivalue.joined_set(F.col("p_brand")).alias("brands"))


@query("""
select o_orderpriority as priority, round(quantile_cont(o_totalprice, 0.0), 4) as low, round(quantile_cont(o_totalprice, 0.25), 4) as q1, round(quantile_cont(o_totalprice, 0.5), 4) as median,
  round(quantile_cont(o_totalprice, 0.75), 4) as q3, round(quantile_cont(o_totalprice, 1.0), 4) as high from orders group by 1""")
def five_numbers(spark: SparkSession, d: str) -> DataFrame:
    told = frames.five_numbers(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return told.select(F.col("o_orderpriority").alias("priority"), *[F.round(c, 4).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query("""
with e as (select cast(min(p_size) as double) as a, cast(max(p_size) as double) as b from part),
     c as (select least(10, cast(floor((p_size - a) / ((b - a) / 10)) as int) + 1) as bin, count(*) as n from part, e group by 1)
select r.bin, coalesce(n, 0) as n from (select cast(unnest(range(1, 11)) as int) as bin) r left join c using (bin)""")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return frames.histogram(table(spark, d, "part"), "p_size").select("bin", "n")


@query("""
with g as (select c_nationkey as nation, avg(c_acctbal) as x from customer group by 1)
select nation, round((x - min(x) over ()) / (max(x) over () - min(x) over ()), 6) as scaled from g""")
def min_max_scaling(spark: SparkSession, d: str) -> DataFrame:
    means = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("x"))
    return frames.min_max_scaled(means, scaled="x").select("nation", F.round("scaled", 6).alias("scaled"))


@query("""
with g as (select n_nationkey as position, n_regionkey as v from nation),
     s as (select *, coalesce(cast(v <> lag(v) over (order by position) as int), 1) as b from g),
     r as (select *, sum(b) over (order by position) as run from s)
select run, v, min(position) as first, max(position) as last from r group by run, v""")
def run_segments(spark: SparkSession, d: str) -> DataFrame:
    return frames.runs(table(spark, d, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_regionkey").alias("v")), "position", "v")


@query("""
with f as (select n_regionkey, dense_rank() over (order by min(n_nationkey)) as label from nation group by 1)
select n_nationkey as nation, label from nation join f using (n_regionkey)""")
def relabel_by_appearance(spark: SparkSession, d: str) -> DataFrame:
    return frames.relabelled(table(spark, d, "nation"), "n_nationkey", "n_regionkey").select(F.col("n_nationkey").alias("nation"), "label")


# --- urls and pages

HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


@query(f"""
with s as (select {HOST} as domain, url, list_filter(string_split({PATH}, '/'), lambda x: x <> '' and not regexp_matches(x, '(?i)\\.(js|css|jpg|jpeg|png|gif|svg|pdf|woff|woff2|ttf|eot)$')) as p from pages)
select distinct domain, url, case when i = 1 then 'Homepage' else p[i - 1] end as parent, p[i] as name from (select *, unnest(range(1, len(p) + 1)) as i from s)""")
def url_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    each = pages.select("url", urls.percent_decode(urls.path(F.col("url"))).alias("path"))
    each = each.select(urls.domain(F.col("url")).alias("domain"), "url", F.explode(urls.parent_pairs(urls.segments(F.col("path")))).alias("e"))
    return each.select("domain", "url", "e.parent", "e.name").distinct()


@query(f"""
select {HOST} as domain, count(*) as n, round(log10(count(*)), 9) as log10_count, median(len(list_filter(string_split({PATH}, '/'), lambda x: x <> ''))) as median_depth
from pages group by 1""")
def url_depth_stats(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").select(urls.domain(F.col("url")).alias("domain"), F.size(urls.segments(urls.path(F.col("url")))).alias("depth"))
    return pages.groupBy("domain").agg(F.count("*").alias("n"), F.round(F.log10(F.count("*")), 9).alias("log10_count"), F.median("depth").alias("median_depth"))


@query(f"""
with g as (select {HOST} as domain, log10(count(*)) as x, avg(length(html)) / 1000.0 as y from pages group by 1)
select count(*) as n, round(corr(y, x), 6) as r, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(regr_r2(y, x), 6) as r2 from g""")
def url_depth_ols(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.log10(F.count("*")).alias("x"), (F.avg(F.length("html")) / 1000).alias("y"))
    return rates.regression(pages, "y", "x").select("n", *[F.round(c, 6).alias(c) for c in ("r", "slope", "intercept", "r2")])


#: P(|T| >= |t|) with f degrees of freedom by the finite sums over powers of the cosine, which Student's T has for whole f.
T_TAIL = """case when f % 2 = 0 then 1 - sin(h) * list_sum(list_transform(range(0, f // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * power(cos(h), 2 * k)))
  else 1 - 2 / pi() * (h + sin(h) * coalesce(list_sum(list_transform(range(0, (f - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * power(cos(h), 2 * k + 1))), 0)) end"""


@query(f"""
with g as (select {HOST} as domain, log10(count(*)) as x, avg(length(html)) / 1000.0 as y from pages group by 1), r as (select count(*) - 2 as f, corr(y, x) as r from g),
  a as (select f, r, atan(abs(r) * sqrt(f / (1 - r * r)) / sqrt(f)) as h from r)
select f + 2 as n, round(r, 9) as r, round({T_TAIL}, 9) as p from a""")
def url_depth_p(spark: SparkSession, d: str) -> DataFrame:
    """Whether the number of a host's pages goes with their length."""
    pages = table(spark, d, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.log10(F.count("*")).alias("x"), (F.avg(F.length("html")) / 1000).alias("y"))
    return rates.regression(pages, "y", "x").select("n", F.round("r", 9).alias("r"), F.round("p", 9).alias("p"))


LINKS = f"""(select distinct {HOST} as host, page_id, unnest(regexp_extract_all(html, 'href="(.*?)"', 1)) as href from pages)"""


@query(f"select page_id, href from {LINKS} group by page_id, href")
def nav_links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(urls.hrefs(F.col("html"))).alias("href")).distinct()


@query(f"""
with u as (select distinct host, href from {LINKS})
select a.host, a.href as parent, b.href as child from u a join u b on a.host = b.host and a.href <> b.href and starts_with(b.href, a.href)""")
def prefix_pairs(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select(urls.domain(F.col("url")).alias("host"), F.explode(urls.hrefs(F.col("html"))).alias("href"))
    return frames.prefix_pairs(links, "host", "href")


@query(f"""
select page_id, length(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*?)/*$', 1)) as n, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*?)/*$', 1) as relative from pages""")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.relative(F.col("url")).alias("relative")).select("page_id", F.length("relative").cast("long").alias("n"), "relative")


@query(r"""
with b as (select page_id, '<url><loc> ' || url || ' </loc></url> see ' || url || '&amp;x ' || html as html from pages),
     f as (select page_id, unnest(list_concat(regexp_extract_all(html, '<loc[^>]*>([^<]+)</loc>', 1, 'i'), regexp_extract_all(html, 'https?://[^\s<>"''\)]+'))) as u from b)
select page_id, count(distinct regexp_replace(regexp_replace(trim(u), '<![^\[]*>', '', 'g'), '&[^;]*;', '', 'g')) as n_urls from f where regexp_matches(trim(u), '^https?://') and length(trim(u)) > 10 group by 1""")
def url_harvest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.size(urls.harvest(F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc></url> see "), "url", F.lit("&amp;x "), "html"))).cast("long").alias("n_urls")).where("n_urls > 0")


@query("""
with h as (select distinct regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages where contains(url, '?'))
select page_id from pages where exists (select 1 from h where contains(lower(url), host))""")
def contains_any_semi(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    hosts = pages.where(F.col("url").contains("?")).select(urls.domain(F.col("url")).alias("host")).distinct()
    return frames.contains_any_semi(pages, "url", hosts, "host").select("page_id")


@query(r"""
with t as (select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) as t from pages),
  d as (select page_id, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') as t from t)
select page_id, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as title from d""")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.text_of_title(F.regexp_extract("html", "(?d)<title>(.*?)</title>", 1)).alias("title"))


# --- texts

@query(r"""
select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) as key from documents""")
def country_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.country_key(F.col("text")).alias("key"))


@query(r"""
select p_partkey, case when length(s) <= 20 then s else substr(s, 1, 9) || '…' || right(s, 10) end as short from (select p_partkey, p_name || ' ' || p_type || ' ' || p_brand as s from part)""")
def middle_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.middle_ellipsis(F.concat_ws(" ", "p_name", "p_type", "p_brand"), 20).alias("short"))


@query("""
select p_type, count(*) as n, count(*) filter (where lower(p_name) like '%red%' or lower(p_name) like '%blue%') as flagged from part group by 1""")
def contains_flag(spark: SparkSession, d: str) -> DataFrame:
    flag = text.contains_any(F.col("p_name"), ["RED", "blue"]).cast("int")
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.sum(flag).alias("flagged"))


@query("""
select n_nationkey as nation, coalesce(m.v, n_name) as canonical from nation left join (values ('FRANCE', 'France'), ('CHINA', 'China'), ('NATION_1', 'Nation one')) m(k, v) on n_name = m.k""")
def dictionary_alias(spark: SparkSession, d: str) -> DataFrame:
    terms = spark.createDataFrame([("FRANCE", "x", 0), ("FRANCE", "France", 1), ("CHINA", "China", 2), ("NATION_1", "Nation one", 3)], "k string, v string, n int")
    told = frames.mapped(table(spark, d, "nation"), "n_name", frames.last_wins(terms, "k", "v", "n"), "k", "v", fallback=True)
    return told.select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("canonical"))


# --- years and panels

SPAN = """(select o_custkey as custkey, min(year(o_orderdate)) as a, max(year(o_orderdate)) as b, o_custkey % 3 = 0 as open from orders group by 1)"""


def published(spark: SparkSession, d: str) -> DataFrame:
    spans = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    told = F.when(F.col("custkey") % 3 == 0, F.concat(F.col("a").cast("string"), F.lit("-"))).otherwise(F.concat_ws("-", "a", "b"))
    return spans.select("custkey", told.alias("published"))


@query(f"select custkey, a as start, case when open then 2025 else b end as \"end\", open as censored from {SPAN}")
def published_span(spark: SparkSession, d: str) -> DataFrame:
    return published(spark, d).select("custkey", years.published_span(F.col("published"), clean=False).alias("s")).select("custkey", "s.start", "s.end", "s.censored")


@query(f"select custkey, a as start, case when open then a else b end as \"end\", open as censored from {SPAN}")
def stated_years(spark: SparkSession, d: str) -> DataFrame:
    return published(spark, d).select("custkey", years.stated_years(F.col("published")).alias("s")).select("custkey", "s.start", "s.end", "s.censored")


MONTH = "(year(o_orderdate) * 12 + month(o_orderdate))"
MONTHS = f"(select o_custkey as custkey, min({MONTH}) as a, max({MONTH}) as b, o_custkey % 3 = 0 as open from orders group by 1)"


def months(spark: SparkSession, d: str) -> DataFrame:
    m = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")
    spans = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), m).groupBy("custkey").agg(F.min("m").alias("start"), F.max("m").alias("end"))
    return spans.withColumn("censored", F.col("custkey") % 3 == 0)


@query(f"""
with s as {MONTHS}, y as (select unnest(range((select min(a) from s), (select max(b) from s) + 1)) as year)
select cast(year as int) as year, (select count(*) from s where a <= year and b >= year) as active, (select count(*) from s where a = year) as births,
  (select count(*) from s where b = year and not open) as deaths, (select count(*) from s where a = year) - (select count(*) from s where b = year and not open) as net from y""")
def year_panel(spark: SparkSession, d: str) -> DataFrame:
    return panels.year_panel(months(spark, d), "custkey")


@query(f"""
with s as {MONTHS}, c as (select distinct o_custkey as custkey, p_brand as code from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey),
  j as (select code, a, b from c join s using (custkey)),
  grid as (select code, unnest(range((select min(a) from j), (select max(b) from j) + 1)) as year from (select distinct code from j)),
  e as (select code, a as year, 1 as x from j union all select code, b + 1, -1 from j),
  t as (select g.code, g.year, coalesce(sum(x), 0) as x from grid g left join e on e.code = g.code and e.year = g.year group by 1, 2)
select code, cast(year as int) as year, cast(sum(x) over (partition by code order by year) as bigint) as active from t""")
def active_by_code(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    codes = lines.select(F.col("o_custkey").alias("custkey"), F.col("p_brand").alias("code"))
    return panels.active_by_code(months(spark, d), codes, "custkey", "code")


# --- survival

SAMPLE = f"""(with o as (select *, {MONTH} as m, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders)
  select o_custkey as custkey, c_mktsegment as grp, min(m) as start_year, max(m) - min(m) + 1 as duration, max(case when r = 1 then case when o_orderstatus <> 'O' then 1 else 0 end end) as event
  from o join customer on o_custkey = c_custkey group by 1, 2)"""
RISK = f"""s as {SAMPLE}, c as (select grp, duration as t, sum(event) as d, count(*) as a from s group by 1, 2),
  r as (select grp, t, d, sum(a) over (partition by grp order by t desc) as n from c),
  k as (select grp, t, d, n, product(1 - d / cast(n as double)) over (partition by grp order by t) as s,
    sum(case when n > d then d / (cast(n as double) * (n - d)) else 0 end) over (partition by grp order by t) as g from r where d > 0)"""


def sample(spark: SparkSession, d: str) -> DataFrame:
    m = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", m.alias("m"))
    last = F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey"))
    each = orders.groupBy(F.col("o_custkey").alias("custkey")).agg(F.min("m").alias("start_year"), (F.max("m") - F.min("m") + 1).alias("duration"), (last != "O").cast("int").alias("event"))
    return each.join(table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_mktsegment").alias("grp")), "custkey")


@query(f"""
with {RISK}, i as (select *, least(greatest(s, 1e-12), 1 - 1e-12) as u from k)
select grp, t, cast(n as bigint) as n, cast(d as bigint) as d, round(s, 9) as s, round(g, 9) as greenwood,
  round(exp(-exp(ln(-ln(u)) + 1.96 * sqrt(g) / abs(ln(u)))), 9) as low, round(exp(-exp(ln(-ln(u)) - 1.96 * sqrt(g) / abs(ln(u)))), 9) as high from i""")
def km_curve(spark: SparkSession, d: str) -> DataFrame:
    told = survival.km(sample(spark, d), ["grp"])
    return told.select("grp", "t", "n", "d", *[F.round(c, 9).alias(c) for c in ("s", "greenwood", "low", "high")])


@query(f"""
with {RISK}, g as (select distinct grp from s)
select g.grp, {", ".join(f"round(coalesce(arg_max(s, t) filter (where t <= {x}), 1.0), 9) as s_{x}" for x in (25, 50, 75))} from g left join k using (grp) group by 1""")
def km_at(spark: SparkSession, d: str) -> DataFrame:
    told = survival.survival_at(survival.km(sample(spark, d), ["grp"]), ["grp"], [25, 50, 75])
    return told.select("grp", *[F.round(c, 9).alias(c) for c in ("s_25", "s_50", "s_75")])


@query(f"with {RISK} select grp, min(t) filter (where s <= 0.5) as median from k group by grp")
def median_survival(spark: SparkSession, d: str) -> DataFrame:
    return survival.median_survival(survival.km(sample(spark, d), ["grp"]), ["grp"])


@query(f"""
with {RISK}, w as (select *, lag(s, 1, 1.0) over (partition by grp order by t) as s0, lag(t, 1, 0) over (partition by grp order by t) as t0 from k)
select grp, round(sum(s0 * greatest(0, least(t, 60) - least(t0, 60))) + arg_max(s, t) * greatest(0, 60 - max(t)), 6) as rmst from w group by grp""")
def rmst(spark: SparkSession, d: str) -> DataFrame:
    return survival.rmst(survival.km(sample(spark, d), ["grp"]), ["grp"], 60).select("grp", F.round("rmst", 6).alias("rmst"))


@query(f"""
with {RISK}, m as (select grp, t from (select grp, duration as t, sum(1 - event) as c from s group by 1, 2) where c > 0)
select m.grp, m.t, round(coalesce((select arg_max(k.s, k.t) from k where k.grp = m.grp and k.t <= m.t), 1.0), 9) as s from m""")
def censor_marks(spark: SparkSession, d: str) -> DataFrame:
    own = sample(spark, d)
    return survival.censor_marks(own, survival.km(own, ["grp"]), ["grp"]).select("grp", "t", F.round("s", 9).alias("s"))


def logrank_sql(strata: str) -> str:
    return f"""
with s as {SAMPLE}, x as (select *, {strata} as stratum from s where grp in ('BUILDING', 'MACHINERY')),
  c as (select stratum, duration as t, sum(event) as d, count(*) as m, sum(case when grp = 'BUILDING' then event else 0 end) as da, count(*) filter (where grp = 'BUILDING') as ma from x group by 1, 2),
  r as (select *, cast(sum(m) over (partition by stratum order by t desc) as double) as n, cast(sum(ma) over (partition by stratum order by t desc) as double) as na,
    sum(ma) over (partition by stratum) as aa, sum(m) over (partition by stratum) as al from c),
  o as (select coalesce(sum(da - d * na / n), 0.0) as o_minus_e, coalesce(sum(d * na / n * (1 - na / n) * (n - d) / (n - 1)), 0.0) as v from r where d > 0 and n > 1 and aa > 0 and aa < al)
select round(o_minus_e, 6) as o_minus_e, round(v, 6) as v, round(o_minus_e / nullif(sqrt(v), 0), 6) as z from o"""


@query(logrank_sql("1"))
def logrank_oe_v(spark: SparkSession, d: str) -> DataFrame:
    return survival.logrank(sample(spark, d), "grp", "BUILDING", "MACHINERY").select(*[F.round(c, 6).alias(c) for c in ("o_minus_e", "v", "z")])


def normal_tail(z: str) -> str:
    """P(|Z| >= |z|) by the series of the error function."""
    x = f"(greatest(abs({z}), 1e-300) / sqrt(2))"
    return f"1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln({x}) + 2 * k * ln(2) + lgamma(k + 1.0) - lgamma(2 * k + 2.0))))"


QUINTILE = " + ".join(["1", *[f"case when start_year > (select quantile_cont(start_year, {q}) from s where grp in ('BUILDING', 'MACHINERY')) and (select quantile_cont(start_year, {q}) from s where grp in ('BUILDING', 'MACHINERY')) > (select quantile_cont(start_year, {p}) from s where grp in ('BUILDING', 'MACHINERY')) then 1 else 0 end" for p, q in ((0, 0.2), (0.2, 0.4), (0.4, 0.6), (0.6, 0.8))]])


@query(logrank_sql(QUINTILE))
def stratified_logrank_oe_v(spark: SparkSession, d: str) -> DataFrame:
    two = sample(spark, d).where(F.col("grp").isin("BUILDING", "MACHINERY"))
    told = survival.logrank(survival.strata(two, "start_year"), "grp", "BUILDING", "MACHINERY", "stratum")
    return told.select(*[F.round(c, 6).alias(c) for c in ("o_minus_e", "v", "z")])


def figures_sql() -> str:
    def side(g: str, mark: str) -> str:
        at = ", ".join(f"round(coalesce((select arg_max(s, t) from k where grp = '{g}' and t <= {x}), 1.0), 6) as s_{x}_{mark}" for x in (25, 50, 100))
        counts = f"(select count(*) from s where grp = '{g}') as n_{mark}, cast((select sum(event) from s where grp = '{g}') as bigint) as events_{mark}, cast((select sum(1 - event) from s where grp = '{g}') as bigint) as censored_{mark}"
        return f"{counts}, cast((select min(t) from k where grp = '{g}' and s <= 0.5) as double) as median_{mark}, {at}, round((select area from w where grp = '{g}'), 6) as rmst_{mark}"

    z = lambda strata: f"(select z from ({logrank_sql(strata)}) as o)"
    return f"""
with {RISK}, l as (select *, lag(s, 1, 1.0) over (partition by grp order by t) as s0, lag(t, 1, 0) over (partition by grp order by t) as t0 from k),
  w as (select grp, sum(s0 * greatest(0, least(t, 60) - least(t0, 60))) + arg_max(s, t) * greatest(0, 60 - max(t)) as area from l group by grp)
select {side("BUILDING", "a")}, {side("MACHINERY", "b")}, {z("1")} as logrank_z, {z(QUINTILE)} as stratified_z,
  round((select area from w where grp = 'BUILDING') - (select area from w where grp = 'MACHINERY'), 6) as rmst_difference"""


@query(figures_sql())
def two_group_figures(spark: SparkSession, d: str) -> DataFrame:
    told = survival.two_group_figures(sample(spark, d), "grp", "BUILDING", "MACHINERY", tau=60)
    whole = [c for c in told.columns if c[:2] in ("n_", "ev", "ce", "me")]
    return told.select(*[F.col(c) if c in whole else F.round(c, 6).alias(c) for c in told.columns])


@query(f"""
with a as ({logrank_sql("1")}), b as ({logrank_sql(QUINTILE)}), z as (select a.z as logrank_z, b.z as stratified_z from a, b)
select logrank_z, round({normal_tail("logrank_z")}, 6) as logrank_p, stratified_z, round({normal_tail("stratified_z")}, 6) as stratified_p from z""")
def two_group_tests(spark: SparkSession, d: str) -> DataFrame:
    """Both log-rank tests of two groups with their p values."""
    two = sample(spark, d).where(F.col("grp").isin("BUILDING", "MACHINERY"))
    test = lambda df, strata: survival.with_p(survival.logrank(df, "grp", "BUILDING", "MACHINERY", strata).withColumn("z", F.round("z", 6)))
    plain = test(two, None).select(F.col("z").alias("logrank_z"), F.round("p", 6).alias("logrank_p"))
    layered = test(survival.strata(two, "start_year"), "stratum").select(F.col("z").alias("stratified_z"), F.round("p", 6).alias("stratified_p"))
    return plain.crossJoin(layered)  # one row each


@query()
def two_group_summary(spark: SparkSession, d: str) -> DataFrame:
    return survival.two_group_summary(sample(spark, d), "segment", "grp", "BUILDING", "MACHINERY", tau=60)


@query()
def bootstrap_rmst(spark: SparkSession, d: str) -> DataFrame:
    return survival.bootstrap_rmst(sample(spark, d), "grp", "BUILDING", "MACHINERY", tau=60)


@query("""
with m as (select distinct l_orderkey as o, n_regionkey as g from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
  k as (select o, list_sort(list(distinct g) filter (where g <> 0)) as g from m group by o)
select o as orderkey, case when coalesce(len(g), 0) = 0 then 'Unknown' when len(g) = 1 then cast(g[1] as varchar) else 'Mixed' end as grp from k""")
def lineage_group(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_suppkey").alias("suppkey")).distinct()
    region = F.when(F.col("n_regionkey") == 0, "Unknown").otherwise(F.col("n_regionkey").cast("string"))
    attributes = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("suppkey"), region.alias("grp"))
    return panels.lineage_groups(members, attributes, "orderkey", "suppkey", "grp")


# --- sets

#: All lines; brands and names are so many pairs that suppliers share few of them.
PAIRS = "(select distinct l_suppkey as site, p_brand as hypernym, p_name as hyponym from lineitem join part on l_partkey = p_partkey)"
ITEM = ["hypernym", "hyponym"]


def pairs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("l_suppkey").alias("site"), F.col("p_brand").alias("hypernym"), F.col("p_name").alias("hyponym")).distinct()


@query(f"""
with s as {PAIRS}, t as (select hypernym, hyponym from s group by 1, 2 having count(*) >= 30), n as (select count(*) as n from t),
  h as (select site, count(*) as size, count(t.hypernym) as hits from s left join t using (hypernym, hyponym) group by 1),
  p as (select site, hits / cast(size as double) as p, hits / cast(greatest(n, 1) as double) as r, n - hits as missing from h, n)
select site, round(p, 9) as precision, round(r, 9) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) as f1, missing from p""")
def site_prf1(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d)
    told = sets.coverage(own, own.groupBy(*ITEM).count().where("count >= 30").select(*ITEM), "site", ITEM)
    return told.select("site", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "missing")


OVERLAPS = f"""s as {PAIRS}, z as (select site, count(*) as n from s group by 1),
  o as (select x.site as a, y.site as b, count(*) as bth from s x join s y using (hypernym, hyponym) where x.site < y.site group by 1, 2)"""


@query(f"with {OVERLAPS} select a, b, round(bth / cast(x.n + y.n - bth as double), 9) as jaccard from o join z x on a = x.site join z y on b = y.site")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sets.jaccard(sets.overlaps(pairs(spark, d), "site", ITEM)).withColumn("jaccard", F.round("jaccard", 9))


@query(f"with {OVERLAPS} select a, b, round(bth / sqrt(x.n * cast(y.n as double)), 9) as cosine from o join z x on a = x.site join z y on b = y.site")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return sets.cosine(sets.overlaps(pairs(spark, d), "site", ITEM)).withColumn("cosine", F.round("cosine", 9))


@query(f"""
with {OVERLAPS}, c as (select a, b, bth, bth / sqrt(x.n * cast(y.n as double)) as s from o join z x on a = x.site join z y on b = y.site),
  u as (select a as site, bth, s from c union all select b, bth, s from c), g as (select site, sum(bth) as shared, sum(s) as sim from u group by 1),
  m as (select z.site, (coalesce(sim, 0) + 1) / (select count(*) from z) as i, (((select count(*) from z) - 1) * n - coalesce(shared, 0)) / cast((select count(*) from z) - 1 as double) as v from z left join g using (site))
select site, round(i, 6) as imitation_raw, round(v, 6) as innovation_raw, round((i - min(i) over ()) / nullif(max(i) over () - min(i) over (), 0), 6) as imitation, round((v - min(v) over ()) / nullif(max(v) over () - min(v) over (), 0), 6) as innovation from m""")
def imitation_innovation(spark: SparkSession, d: str) -> DataFrame:
    told = sets.imitation_innovation(pairs(spark, d), "site", ITEM)
    return told.select("site", *[F.round(c, 6).alias(c) for c in ("imitation_raw", "innovation_raw", "imitation", "innovation")])


LIFT = f"""s as {PAIRS}, c as (select site % 3 as cluster, hypernym, hyponym, count(*) as n from s group by 1, 2, 3),
  l as (select cluster, hypernym, hyponym, n, n / cast(sum(n) over (partition by cluster) as double) as share, sum(n) over (partition by hypernym, hyponym) / cast(sum(n) over () as double) as every from c)"""


def lifts(spark: SparkSession, d: str) -> DataFrame:
    return sets.distinctiveness(pairs(spark, d).withColumn("cluster", F.col("site") % 3), "cluster", ITEM)


@query(f"with {LIFT} select cluster, hypernym, hyponym, n, round(share, 9) as share, round(share / every, 6) as lift from l")
def distinctive_pairs(spark: SparkSession, d: str) -> DataFrame:
    return lifts(spark, d).select("cluster", *ITEM, "n", F.round("share", 9).alias("share"), F.round("lift", 6).alias("lift"))


@query(f"with {LIFT} select cluster, hypernym, hyponym, round(share / every, 6) as lift, row_number() over (partition by cluster order by round(share / every, 6) desc, hypernym, hyponym) as rank from l qualify rank <= 5")
def top_distinctive(spark: SparkSession, d: str) -> DataFrame:
    told = lifts(spark, d).withColumn("lift", F.round("lift", 6))
    return frames.top_per_group(told, ["cluster"], [F.desc("lift"), *ITEM], 5).select("cluster", *ITEM, "lift", "rank")


@query(f"""
with s as {PAIRS}, n as (select site % 3 as cluster, count(distinct site) as n from s group by 1), h as (select distinct site, hypernym as hyponym from s),
  k as (select site % 3 as cluster, hyponym, count(*) as k from h group by 1, 2), g as (select cluster, n, hyponym from n, (select distinct hyponym from h))
select g.cluster, g.hyponym, round(coalesce(k, 0) / cast(n as double), 9) as coverage from g left join k on g.cluster = k.cluster and g.hyponym = k.hyponym""")
def first_level_coverage(spark: SparkSession, d: str) -> DataFrame:
    own = pairs(spark, d)
    own = own.union(own.select("site", F.lit("Homepage"), "hypernym").distinct())  # brands stand below the root
    clusters = own.select("site").distinct().withColumn("cluster", F.col("site") % 3)
    return sets.first_level_coverage(own, clusters, "site", "cluster").withColumn("coverage", F.round("coverage", 9))


@query(f"""
with {OVERLAPS}, j as (select a, b, bth / cast(x.n + y.n - bth as double) as s from o join z x on a = x.site join z y on b = y.site), n as (select site % 3 as cluster, count(*) as n from z group by 1),
  w as (select a % 3 as cluster, sum(s) as s from j where a % 3 = b % 3 group by 1)
select n.cluster, round((2 * coalesce(s, 0) + n) / (n * cast(n as double)), 9) as mean from n left join w using (cluster)""")
def block_means(spark: SparkSession, d: str) -> DataFrame:
    own = frames.cut(pairs(spark, d))
    clusters = own.select("site").distinct().withColumn("cluster", F.col("site") % 3)
    told = sets.block_means(sets.jaccard(sets.overlaps(own, "site", ITEM)), clusters, "site", "cluster", "jaccard")
    return told.withColumn("mean", F.round("mean", 9))


@query()
def ward_clusters(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", F.struct(F.col("p_brand"), F.col("p_name")).alias("pair"))
    numbers = frames.cut(scans.numbered_by(parts.select("pair").distinct(), "pair", name="item").withColumn("item", F.col("item").cast("int")))
    coded = frames.cut(parts.join(numbers, "pair").select("p_partkey", "item"))  # so that lines carry numbers, not names
    lines = table(spark, d, "lineitem").join(coded, F.col("l_partkey") == F.col("p_partkey"))
    own = frames.cut(lines.select(F.col("l_suppkey").alias("site"), "item").distinct())
    same = frames.cut(sets.same_sets(own, "site", ["item"]))
    firsts = own.join(same.where("site = first").select("site"), "site", "left_semi")
    return cluster.ward_clusters(own, lambda: sets.jaccard(sets.overlaps(firsts, "site", ["item"])), "site", "jaccard", same=same, items=firsts)


# --- graphs

EDGES = "(select distinct 'o' || l_orderkey as src, 'p' || l_partkey as dst from lineitem)"
BOTH = f"e as materialized (select src, dst from {EDGES} union select dst, src from {EDGES})"
#: Rounds after which the least label has reached every node of the tables at hand; the last one shows that none changes any more.
LABEL_ROUNDS = 14


def bipartite(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


@query(
    f"with {BOTH}, r0 as materialized (select distinct src as node, src as label from e)"
    + "".join(f", r{k + 1} as materialized (select r.node, least(r.label, min(x.label)) as label from r{k} r join e on e.src = r.node join r{k} x on x.node = e.dst group by r.node, r.label)" for k in range(LABEL_ROUNDS))
    + f" select r.node, case when r.label = x.label then r.label end as component from r{LABEL_ROUNDS} r join r{LABEL_ROUNDS - 1} x using (node)"
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(bipartite(spark, d))


@query(f"""
with {BOTH}, r as materialized (select distinct 'o' || l_orderkey as node from lineitem join orders on l_orderkey = o_orderkey where o_totalprice = (select max(o_totalprice) from lineitem join orders on l_orderkey = o_orderkey)),
  a as materialized (select distinct dst as node from e join r on src = node where dst not in (select node from r)), b as (select distinct dst as node from e join a on src = node where dst not in (select node from r) and dst not in (select node from a))
select node, 0 as depth from r union all select node, 1 from a union all select node, 2 from b""")
def bfs_depth(spark: SparkSession, d: str) -> DataFrame:
    """From the largest order that has lines, two steps over all lines."""
    own = bipartite(spark, d)
    priced = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")
    start = priced.join(priced.agg(F.max("o_totalprice").alias("most")), F.col("o_totalprice") == F.col("most")).select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.bfs(own.union(own.select("dst", "src").toDF("src", "dst")), start, 2)


TAXONOMY = """(select 'Homepage' as parent, r_name as child from region union all select r_name, n_name from nation join region on n_regionkey = r_regionkey union all select n_name, s_name from supplier join nation on s_nationkey = n_nationkey)"""


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    region, nation, supplier = (table(spark, d, n) for n in ("region", "nation", "supplier"))
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        region.select(F.lit("Homepage").alias("parent"), F.col("r_name").alias("child"))
        .union(named.select("r_name", "n_name"))
        .union(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_name"))
    )


@query(f"""
with recursive t as {TAXONOMY}, s as (select o_custkey % 50 as sitedomain, n_name as hypernym, s_name as hyponym from orders join lineitem on o_orderkey = l_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
  c(sitedomain, hypernym, hyponym) as (select distinct * from s union select c.sitedomain, t.parent, t.child from c join t on t.child = c.hypernym or t.child = c.hyponym)
select sitedomain, hypernym, hyponym from c""")
def taxonomy_closure(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    own = frames.cut(lines.select((F.col("o_custkey") % 50).alias("sitedomain"), "l_suppkey").distinct())  # numbers, before names make rows long
    own = own.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = own.select("sitedomain", F.col("n_name").alias("hypernym"), F.col("s_name").alias("hyponym"))
    return graph.with_missing_ancestors(own, taxonomy(spark, d))


@query(f"""
with recursive t as {TAXONOMY}, r(node, parent, depth) as (select 'Homepage', cast(null as varchar), 0 union all select t.child, t.parent, depth + 1 from r join t on t.parent = r.node)
select node, parent, depth from r""")
def taxonomy_tree(spark: SparkSession, d: str) -> DataFrame:
    return graph.tree(taxonomy(spark, d))


@query(f"with t as {TAXONOMY} select distinct parent as node from t where parent not in (select child from t)")
def taxonomy_roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.roots(taxonomy(spark, d))


# --- resolving

@query("""
with b as (select item_id, list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) as t from benchmark),
  d as (select doc_id, list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) as t from documents),
  x as (select item_id, unnest(t) as w from b), y as (select doc_id, unnest(t) as w from d),
  s as (select item_id, doc_id, count(*) * 4 as score from x join y using (w) where w <> '' group by 1, 2)
select item_id, doc_id, score from s where score >= 80 qualify row_number() over (partition by item_id order by score desc, doc_id) = 1""")
def entity_score_top1(spark: SparkSession, d: str) -> DataFrame:
    tokens = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), ""))
    asked = table(spark, d, "benchmark").select("item_id", tokens(F.col("text")).alias("words"))
    held = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("words"))
    shared = sets.share_words(asked, "item_id", held, "doc_id", "words", resolve.LEAST // resolve.PER_TOKEN)
    points = shared.select("item_id", "doc_id", (F.col("shared") * resolve.PER_TOKEN).cast("long").alias("score"))
    best = points.groupBy("item_id").agg(F.min(F.struct((-F.col("score")).alias("below"), "doc_id")).alias("m"))  # a row for each item leaves a task
    return best.select("item_id", "m.doc_id", (-F.col("m.below")).alias("score"))


@query("""
select c_custkey, case when c_custkey % 4 = 0 then 'gsa' || substr(sha256(cast(c_custkey as varchar)), 1, 24) else c_name end as acad_id from customer""")
def fill_blank_ids(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit("  ")).otherwise(F.col("c_name")).alias("acad_id"))
    return frames.fill_blank_ids(own, "acad_id", "c_custkey")


@query("""
select c_custkey, case when c_custkey % 3 = 0 then (case when c_nationkey % 5 = 0 then null else 'N' || c_nationkey end) else c_name end as name, case when c_custkey % 3 = 0 and c_nationkey % 5 <> 0 then 1 else 0 end as filled from customer""")
def fill_blank_only(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.lit(" ")).otherwise(F.col("c_name")).alias("name"))
    resolved = own.select("c_custkey", F.when(F.col("c_nationkey") % 5 == 0, F.lit("N/A")).otherwise(F.concat(F.lit("N"), "c_nationkey")).alias("name"))
    return frames.fill_blank(own.drop("c_nationkey"), resolved, "c_custkey", ["name"])


# --- rows and keys

@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '2001-06-01')")
def processed_anti(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where(F.col("o_orderdate") >= "2001-06-01").select(F.col("o_custkey").alias("c_custkey"))
    return frames.anti(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query("select 'orders' as child, count(*) as n from orders where o_custkey not in (select c_custkey from customer) union all select 'lineitem', count(*) from lineitem where l_partkey not in (select p_partkey from part)")
def dq_fk(spark: SparkSession, d: str) -> DataFrame:
    checks = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_partkey", "part", "p_partkey")]
    counted = [frames.orphans(table(spark, d, c), k, table(spark, d, p), pk).agg(F.lit(c).alias("child"), F.count("*").alias("n")) for c, k, p, pk in checks]
    return counted[0].unionByName(counted[1])


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def dq_unique(spark: SparkSession, d: str) -> DataFrame:
    return frames.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("select distinct c_nationkey as k from customer union select s_nationkey from supplier")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return frames.union_distinct(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("select n_name, n_regionkey from nation union all select v.n_name, v.n_regionkey from (values ('FRANCE', 9), ('ATLANTIS', 9)) v(n_name, n_regionkey) where v.n_name not in (select n_name from nation)")
def append_absent(spark: SparkSession, d: str) -> DataFrame:
    more = spark.createDataFrame([("FRANCE", 9), ("ATLANTIS", 9)], "n_name string, n_regionkey int")
    return frames.append_absent(table(spark, d, "nation").select("n_name", "n_regionkey"), more, "n_name")


@query("select c_custkey, c_mktsegment as segment from customer where c_mktsegment is distinct from 'BUILDING'")
def not_equal_sentinel(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return own.where(frames.not_equal_keeping_null(F.col("segment"), "BUILDING"))


@query("select c_nationkey as nation, max(case when o_orderstatus = 'F' then 1 else 0 end) as flag from customer join orders on c_custkey = o_custkey group by 1")
def flag_max(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("nation")).agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("flag"))


@query("select n_nationkey as nation, case when exists (select 1 from supplier where s_nationkey = n_nationkey and s_acctbal < 0) then 1 else 0 end as flag from nation")
def host_flag(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"))
    return rates.flag_of(keys, "nation", table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("nation")))




# --- more of the functions, over constructed columns


@query("""
with s as """ + SAMPLE + """, e as (select quantile_cont(start_year, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) as q from s), d as (select list_sort(list_distinct(q))[2:-2] as q from e)
select custkey, 1 + len(list_filter(q, lambda x: start_year > x)) as stratum from s, d""")
def quantile_strata(spark: SparkSession, d: str) -> DataFrame:
    return survival.strata(sample(spark, d), "start_year").select("custkey", F.col("stratum").cast("long").alias("stratum"))


@query("select doc_id, case when lower(w) like '%developed%' then 'Developed' when lower(w) like '%developing%' then 'Developing' else 'Unknown' end as grp from (select doc_id, case doc_id % 3 when 0 then 'Developed regions' when 1 then 'developing' end as w from documents)")
def development_classes(spark: SparkSession, d: str) -> DataFrame:
    told = F.when(F.col("doc_id") % 3 == 0, "Developed regions").when(F.col("doc_id") % 3 == 1, "developing")
    return table(spark, d, "documents").select("doc_id", rates.development_class(told).alias("grp"))


@query("select n_nationkey as nation, case n_nationkey % 4 when 0 then 'Russian Federation' when 1 then 'Viet Nam' when 2 then n_name else '' end as country from nation")
def canonical_countries(spark: SparkSession, d: str) -> DataFrame:
    told = F.when(F.col("n_nationkey") % 4 == 0, " Russia; France").when(F.col("n_nationkey") % 4 == 1, "VIETNAM").when(F.col("n_nationkey") % 4 == 2, F.col("n_name"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), academies.canonical_country(told).alias("country"))


@query("select c_custkey, c_custkey % 5 in (0, 1, 2) as missing, c_custkey % 5 in (1, 3) or c_custkey % 7 = 0 as ask from customer")
def missing_and_geocode(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    told = F.when(k % 5 == 0, " ").when(k % 5 == 1, "N/A").when(k % 5 == 2, "nan").when(k % 5 == 3, F.lit(None).cast("string")).otherwise("x")
    lat, lng = F.when(k % 5 == 1, "N/A").when(k % 5 != 3, "1.5"), F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise("2")
    return table(spark, d, "customer").select("c_custkey", (text.is_missing_like(told) & (k % 5 != 3)).alias("missing"), frames.needs_geocode(lat, lng).alias("ask"))


@query("""
with c as (select p_partkey, printf('%03d', p_size) as a, printf('%03d', p_partkey % 10 * 100) as b from part)
select b as code, count(distinct p_partkey) as n from (select p_partkey, a as b from c union all select p_partkey, b from c) group by 1""")
def subject_codes(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat_ws("; ", F.lpad(F.col("p_size").cast("string"), 3, "0"), F.concat(F.lpad((F.col("p_partkey") % 10 * 100).cast("string"), 3, "0"), F.lit(" x|9999, none")))
    cleaned = table(spark, d, "part").select("p_partkey", text.clean_text(cell).alias("cell"))
    return cleaned.select("p_partkey", F.explode(multivalue.subject_codes(F.col("cell"))).alias("code")).groupBy("code").agg(F.count_distinct("p_partkey").alias("n"))


@query("select p_partkey, lower(p_name) || '#' || lower(p_type) as related from part")
def related_titles(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(F.lit(" / "), "p_name", F.lit(" / - /"), F.upper("p_type"), F.lit("/"), F.upper("p_name"), F.lit(" / —"))
    return table(spark, d, "part").select("p_partkey", F.array_join(multivalue.related_titles(cell), "#").alias("related"))


@query("""
with j as (select p_partkey as id, lower(p_name) as t, p_partkey % 7 as body from part), r as (select a.id as src, b.id as dst, a.body as x, b.body as y, count(*) over (partition by a.id) as many from j a join j b on b.t = a.t and b.id <> a.id where a.id % 5 = 0)
select src, dst from r join (select t, count(*) as n from j group by 1) c on c.t = (select t from j where id = src) where c.n = 1 or x = y""")
def checked_title_links(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    related = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("/ "), "p_name"))
    journals = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), related.alias("related"), (F.col("p_partkey") % 7).cast("string").alias("body"))
    return panels.title_links_checked(journals, "id", "title", "related", "body")


@query("select page_id, count(*) as n from (select distinct page_id, h from (select page_id, unnest(regexp_extract_all(html, 'href=\"(.*?)\"', 1)) as h from pages) where starts_with(h, '/')) group by 1")
def same_host_links(spark: SparkSession, d: str) -> DataFrame:
    told = table(spark, d, "pages").select("page_id", F.size(urls.same_host_links(F.col("html"), F.col("url"))).cast("long").alias("n"))
    return told.where("n > 0")


@query("select event_id, event_id % 4 <> 0 as by_end, event_id % 4 not in (0, 1) as anywhere, event_id % 3 <> 0 as sane from events")
def page_filters(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    url = F.concat(F.when(k % 3 == 0, "ftp://a.org/").otherwise("http://a.org/"), F.when(k % 4 == 0, "x.PDF").when(k % 4 == 1, "x.json").otherwise("about"))
    return table(spark, d, "events").select("event_id", urls.is_page(url).alias("by_end"), urls.is_page(url, anywhere=True).alias("anywhere"), urls.is_sane(url).alias("sane"))


@query("select event_id, 'http://a/' || cast(json_extract(props, '$.k') as varchar) as url from events where json_extract(props, '$.k') is not null")
def archive_listings(spark: SparkSession, d: str) -> DataFrame:
    n = F.get_json_object("props", "$.k")
    payload = F.concat(F.lit('[["k","t","o"],["x","1","http://a/'), n, F.lit('"],["y","2","http://a/'), n, F.lit('"],["z"]]'))
    return archive_listing(table(spark, d, "events").select("event_id", payload.alias("p")), "p", "event_id")


@query("""
select c_custkey as k, 'Q' || n_nationkey as id, cast(120 + 4 * 2 * len(list_distinct(string_split(lower(n_name), ' '))) + 25 + 8 + 1 as int) as score
from customer join nation on c_nationkey = n_nationkey """)
def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    entities = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    own = entities.select(F.col("c_custkey").alias("k"), F.array("n_name").alias("names"), F.lower(F.col("n_name")).alias("country"))
    label = F.regexp_replace(F.lower("n_name"), "[^a-z0-9_ ]", " ")
    found = entities.select(F.col("c_custkey").alias("k"), F.concat(F.lit("Q"), "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.concat(F.lit("academy in "), label).alias("description"), F.array().cast("array<string>").alias("aliases"), F.lit(0).alias("position"))
    return resolve.best_candidates(own, found, "k", "names", "country")


@query("select c_custkey as k, unnest(case when c_custkey % 2 = 0 then [c_name, c_name || ' Peru', c_mktsegment, c_mktsegment || ' Peru'] else [c_name, c_mktsegment] end) as query from customer")
def search_queries(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("a"), F.concat(F.lit(" "), "c_name").alias("b"), F.col("c_mktsegment").alias("c"), F.when(F.col("c_custkey") % 2 == 0, "Peru").alias("p"))
    return resolve.search_queries(own, "k", ["a", "b", "c"], "p").select("k", "query")


@query("""
select s_suppkey as k, case when s_suppkey % 3 = 0 then 'Q' || s_suppkey when s_suppkey % 3 = 1 then 'Q' || s_suppkey end as wikidata_id, case when s_suppkey % 3 <> 2 then 'T' || s_suppkey end as title,
  case when s_suppkey % 3 <> 2 and s_suppkey % 2 = 0 then 'http://d/' || s_suppkey end as dbpedia_url from supplier""")
def identifier_cross_walk(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    blank = F.lit(None).cast("string")
    own = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Q"), k)).alias("wikidata_id"), F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("T"), k)).alias("title"), blank.alias("dbpedia_url"))
    walk = table(spark, d, "supplier").select(F.concat(F.lit("Q"), k).alias("qid"), F.concat(F.lit("T"), k).alias("title"), F.concat(F.lit("http://d/"), k).alias("dbpedia_url"), (F.col("s_suppkey") % 2 == 0).alias("dbpedia_exists"))
    return resolve.cross_walk(own, walk)


@query("select c_custkey, case when c_custkey % 2 = 0 then 'lat' || c_nationkey else 'old' end as latitude from customer")
def geocoded(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    place = F.concat(F.lit("p"), F.col("c_nationkey").cast("string"))
    own = table(spark, d, "customer").select("c_custkey", F.when(k % 4 == 0, place).otherwise(" ").alias("address"), F.when(k % 2 == 0, place).otherwise("unknown").alias("headquarters"), F.lit("old").alias("latitude"), F.lit("old").alias("longitude"), F.lit("old").alias("country"))
    n = F.col("n_nationkey").cast("string")
    places = table(spark, d, "nation").select(F.concat(F.lit("p"), n).alias("place"), F.concat(F.lit("lat"), n).alias("latitude"), F.lit("N/A").alias("longitude"), F.lit("x").alias("country"))
    return resolve.geocoded(own, places).where("longitude = 'old'").select("c_custkey", "latitude")


@query("select c_custkey from customer order by c_acctbal desc, c_custkey limit 7")
def ordered_limit(spark: SparkSession, d: str) -> DataFrame:
    return frames.limited(table(spark, d, "customer"), 7, F.desc("c_acctbal"), "c_custkey").select("c_custkey")


@query("""
select c_custkey, case when c_custkey % 6 = 0 then 'no_valid_url' else 'sitemap' end as method,
  case c_custkey % 6 when 0 then 'failed' when 1 then 'no_urls_found' when 2 then 'domain_extraction_failed' when 3 then 'save_failed' else 'success' end as status from customer""")
def retrieval_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    website = F.when(k == 0, F.when(F.col("c_custkey") % 4 == 0, "-")).when(k == 2, "somewhere").otherwise("https://a.org/x")
    urls = F.when(k == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("https://a.org/1")))
    method, status = resolve.retrieval_outcome(website, F.lit("sitemap"), urls, k > 3)
    return table(spark, d, "customer").select("c_custkey", method.alias("method"), status.alias("status"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'none' else 'a' || c_nationkey || '@x.org, b@' || lower(c_mktsegment) || '.org' end as mails from customer")
def email_lists(spark: SparkSession, d: str) -> DataFrame:
    own = F.concat(F.lit("<a href='mailto:b@"), F.lower("c_mktsegment"), F.lit(".org?subject=hello'>b</a> <a href=\"MAILTO:a"), F.col("c_nationkey").cast("string"), F.lit("@x.org\">a</a> <a href='mailto:b@"), F.lower("c_mktsegment"), F.lit(".org'>"))
    html = F.when(F.col("c_custkey") % 3 == 0, "<p>no@link.org</p>").otherwise(own)
    return table(spark, d, "customer").select("c_custkey", urls.emails(html, "none").alias("mails"))


@query("""
select event_id, case event_id % 4 when 0 then 'standard' when 1 then 'regex' when 2 then 'regex' else 'failed' end as parsing_method,
  case event_id % 4 when 0 then 'http://s.org/' || user_id when 1 then 'http://r.org/' || user_id || '|http://r.org/x' when 2 then 'http://t.org/' || user_id else '' end as urls from events""")
def sitemap_ladder(spark: SparkSession, d: str) -> DataFrame:
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    content = F.when(k == 1, F.concat(F.lit("<urlset><url><LOC> http://r.org/"), u, F.lit(" </LOC><loc>http://r.org/x</loc>"))).when(k == 2, F.concat(F.lit("broken < http://t.org/"), u, F.lit(" and so on"))).otherwise("ftp://no http:/no")
    standard = F.when(k == 0, F.array(F.concat(F.lit("http://s.org/"), u)))
    told = table(spark, d, "events").select("event_id", urls.sitemap_urls(content, standard).alias("s"))
    return told.select("event_id", "s.parsing_method", F.array_join("s.urls", "|").alias("urls"))


@query("select n_nationkey, n_name as name, 'Area ' || n_regionkey as area, 'http://w/' || n_nationkey as href from nation where n_nationkey % 5 <> 0")
def founding_tables(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    rows = F.concat(F.lit("<tr><td colspan=\"3\"><b>Area "), F.col("n_regionkey").cast("string"), F.lit("</b></td></tr><tr><th>Founded</th><th>Name</th><th>x</th></tr><tr><td>1</td><td><a href=\"http://w/"), n, F.lit("\">"), "n_name", F.lit("</a></td><td>z</td></tr><tr><td>two cells</td><td>only</td></tr>"))
    html = F.concat(F.lit("<table><tr><td>0</td><td>1</td><td>2</td></tr></table><h2 id=\"list\">List</h2>"), F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("<table>"), rows, F.lit("</table>"))).otherwise(""))
    told = table_rows(table(spark, d, "nation").select("n_nationkey", html.alias("html")), "n_nationkey", "html", "list")
    return told.select("n_nationkey", F.col("c1").alias("name"), "area", F.col("link.href").alias("href"))


def journals(spark: SparkSession, d: str) -> DataFrame:
    """Parts as journals: each names the next one as related, five in a row; every third has no end."""
    k = F.col("p_partkey")
    title = lambda n: F.concat(F.lit("Journal "), n.cast("string"))
    related = F.when(k % 5 != 0, F.concat(F.lit("/ "), F.upper(title(k + 1))))
    published = F.when(k % 3 == 0, F.concat((F.col("p_size") + 1900).cast("string"), F.lit("-"))).otherwise(F.concat_ws("-", F.col("p_size") + 1900, F.col("p_size") + 1930))
    return table(spark, d, "part").select(k.alias("id"), title(k).alias("title"), related.alias("related"), published.alias("published"))


CHAINS = "(select p_partkey as id, cast((p_partkey + 4) // 5 as bigint) as chain, p_size + 1900 as a, p_size + 1930 as b, p_partkey % 3 = 0 as open from part)"


@query(f"""
with j as {CHAINS}, g as (select min(id) as lineage, string_agg(id, '|' order by id) as members, count(*) as n_titles, min(a) as start_year, max(case when not open then b end) as last, bool_or(open) as open from j group by chain)
select lineage, members, n_titles, start_year, case when open or last is null then {panels.HORIZON} else last end as end_year, case when open or last is null then 0 else 1 end as event, case when open or last is null then {panels.HORIZON} else last end - start_year + 1 as duration from g""")
def journal_lineages(spark: SparkSession, d: str) -> DataFrame:
    told = panels.lineages(journals(spark, d), "id", "title", "related", "published")
    return told.withColumn("members", F.array_join(F.transform("members", lambda x: x.cast("string")), "|"))


@query(f"select x.id as src, y.id as dst from {CHAINS} x join {CHAINS} y on y.id = x.id + 1 and x.id % 5 <> 0")
def plain_title_links(spark: SparkSession, d: str) -> DataFrame:
    return panels.title_links(journals(spark, d), "id", "title", "related")


@query(f"select min(id) as component, count(*) as size, string_agg(cast(id as varchar), ' | ' order by cast(id as varchar)) as ids, string_agg('Journal ' || id, ' | ' order by 'Journal ' || id) as titles from {CHAINS} group by chain")
def journal_families(spark: SparkSession, d: str) -> DataFrame:
    own = journals(spark, d)
    told = panels.families(own.withColumn("id", F.col("id").cast("string")), panels.title_links(own, "id", "title", "related").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), "id", "title")
    return told.withColumn("component", F.array_min(F.transform(F.split("ids", r" \| "), lambda x: x.cast("long"))))


@query("select l_orderkey * 10 + l_linenumber as record, k, v from (select l_orderkey, l_linenumber, unnest(['001', '016_a', '245_a']) as k, unnest(['c' || min(l_partkey), 'z' || min(l_suppkey) || ' | y', 'Title ' || min(l_partkey)]) as v from lineitem group by 1, 2)")
def marc_flattened(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record")).agg(F.min("l_partkey").cast("string").alias("p"), F.min("l_suppkey").cast("string").alias("s"))
    part = lambda code, v: F.struct(F.lit(code).alias("_code"), v.alias("_VALUE"))
    field = lambda tag, *subs: F.struct(F.lit(tag).alias("_tag"), F.array(*subs).alias("marc:subfield"))
    records = own.select("record", F.array(F.struct(F.lit("001").alias("_tag"), F.concat(F.lit("c"), "p").alias("_VALUE"))).alias("controlfields"), F.array(field("016", part("a", F.concat(F.lit("z"), "s")), part("b", F.lit(""))), field("245", part("a", F.concat(F.lit("Title "), "p"))), field("016", part("a", F.lit("y")))).alias("datafields"))
    # Outer, as a filter on the size of a map that is inferred for the inner one would make the map two times more.
    return marc_values(records).select("record", F.explode_outer("values").alias("k", "v")).where("k is not null")


@query("select s_suppkey, 'Z' || s_suppkey as zdb_id, 'Academy ' || s_nationkey || ' (Section)' as corporate_body, '(DE-588)' || s_suppkey as koeref from supplier union all select s_suppkey, 'Z' || s_suppkey, 'Other body', 'N/A' from supplier")
def marc_corporate_bodies(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    part = lambda code, v: F.struct(F.lit(code).alias("_code"), v.alias("_VALUE"))
    field = lambda tag, *subs: F.struct(F.lit(tag).alias("_tag"), F.array(*subs).alias("marc:subfield"))
    fields = F.array(field("710", part("a", F.lit("Other body"))), field("016", part("2", F.lit("DE-101")), part("a", F.lit("no"))), field("016", part("2", F.lit("DE-600")), part("a", F.concat(F.lit("Z"), k))), field("110", part("a", F.concat(F.lit("Academy "), F.col("s_nationkey").cast("string"))), part("b", F.lit("Section")), part("0", F.concat(F.lit("(DE-588)"), k))))
    told = marc_bodies(table(spark, d, "supplier").select(fields.alias("datafields")))
    return told.select(F.regexp_extract("zdb_id", "Z(.*)", 1).cast("long").alias("s_suppkey"), "zdb_id", "corporate_body", "koeref")
