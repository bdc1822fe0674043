from pyspark.sql import functions as F

from scriptorium.operators import academies, rates
from scriptorium.plans import studies


def test_golden_rates(spark):
    groups = {"Developing": (49, 114), "Developed": (112, 178)}
    rows = [(g, int(i < k)) for g, (k, n) in groups.items() for i in range(n)]
    got = {r["g"]: r for r in rates.rates(spark.createDataFrame(rows, "g string, f int"), "g", "f").collect()}
    assert round(100 * got["Developing"]["rate"], 1) == 43.0 and round(100 * got["Developed"]["rate"], 1) == 62.9


def test_hosted_rates(spark):
    roster = spark.createDataFrame(
        [("a1", "Academy A", "France", "Engineering Sciences"), ("a2", "Academy B", "russia; France", None), ("a3", "The African Academy of Sciences", "Kenya", ""), ("a4", "D", "Kosovo", "x"), ("a5", "E", "Nowhere", "ENGINEERING")],
        "acad_id string, acad_name string, country string, discipline string",
    )
    countries = spark.createDataFrame([("France", "Developed regions"), ("Russian Federation", "Developed"), ("Kenya", "Developing"), ("Kenya", "Developing"), ("X", "-")], "country string, dev_group string")
    hosts = spark.createDataFrame([("k1", "a1"), ("N/A", "a2"), (None, "a4"), ("k2", "a4"), ("k3", "a4")], "koeRef string, acad_id string")
    by_class, by_field = studies.hosted_rates(roster, countries, hosts)
    assert {r["dev_group"]: (r["k"], r["n"]) for r in by_class.collect()} == {"Developed": (1, 2), "Developing": (1, 1)}
    assert {r["field"]: (r["k"], r["n"]) for r in by_field.collect()} == {"Engineering": (1, 2), "Non-engineering": (1, 2)}
    assert [r[0] for r in academies.removed_transnational(roster).collect()] == ["The African Academy of Sciences"]


JOURNALS = [
    ("1", "A", "Periodical (Journal)", "1900-1910", "/ B", "x", "500; 510", "k1"),
    ("2", "B", " Periodical (Journal) ", "1911-1950", "A /", "x", "500", "k1"),
    ("3", "C", "Periodical (Journal)", "1960-", None, "y", "010", "k2"),
    ("4", "D", "Series", "1960-", None, "y", "010", "k2"),
    ("5", "E", "Periodical (Journal)", None, None, "z", None, "-"),
    ("6", "F", "Periodical (Journal)", "1980-1990", None, "z", "500", "k2"),
]


def journals(spark):
    return spark.createDataFrame(JOURNALS, ["ZDB-ID", "Title", "Type of publication", "Published", "Former/later titles", "Corporate body", "DDC subject groups", "Source_koeRef"])


def test_journal_survival(spark):
    mapping = spark.createDataFrame([("k1", "a1"), ("k2", "a2"), ("-", "a9")], "koeRef string, acad_id string")
    hosted = academies.hosts_of_journals(journals(spark), mapping)
    attributes = spark.createDataFrame([("a1", "Engineering", "Developed"), ("a2", "Non-engineering", "Developing")], "acad_id string, eng_group string, dev_group string")
    told, summary = studies.journal_survival(journals(spark), hosted, attributes, replicates=20)
    got = {r["lineage"]: (r["n_titles"], r["duration"], r["event"], r["eng_group"]) for r in told.collect()}
    assert got == {"1": (2, 51, 1, "Engineering"), "3": (1, 66, 0, "Non-engineering"), "6": (1, 11, 1, "Non-engineering")}
    rows = summary.collect()
    assert len(rows) == 2 and len(summary.columns) >= 25 and rows[0]["n_a"] == 1 and rows[0]["n_b"] == 2


def test_journal_dynamics(spark):
    out = studies.journal_dynamics(journals(spark), spark.createDataFrame([("500", "Science")], "code string, label string"))
    assert out["panel"].where("year = 1960").first()["births"] == 1
    assert {r["code"]: (r["n_journals"], r["label"]) for r in out["codes"].collect()} == {"500": (3, "Science"), "510": (1, None), "010": (1, None)}
    assert out["active"].where("year = 1905").groupBy("code").agg(F.sum("active").alias("n")).where("n > 0").count() == 2
    assert [(r["id"], r["start"]) for r in out["gantt"].orderBy("position").collect()] == [("1", 1900), ("2", 1911)]
    assert out["families"].agg(F.max("size")).first()[0] == 2


def test_site_hierarchy_and_structure(spark):
    urls = spark.createDataFrame([("A", "http://a.org/About%20us/Staff?x", "a.org"), ("A", "http://a.org/x.pdf", "a.org"), ("B", "http://b.org/News", "b.org"), ("C", "http://c.org/News", "c.org")], "site_name string, loc string, sitedomain string")
    sites = spark.createDataFrame([("a.org",), ("b.org",)], "sitedomain string")
    tags = spark.createDataFrame([("Staff",), ("News",), (None,)], "tag string")
    menu = spark.createDataFrame([("A", "http://a.org/m", "Menu"), ("A", "http://a.org/mx", "Item"), ("A", "http://a.org/n", None)], "site_name string, loc string, Response string")
    terms = spark.createDataFrame([("Staff", "old", 0), ("Staff", "People", 1), ("About us", "About", 2), ("Homepage", "Homepage", 3), ("News", "News", 4), ("Menu", "Menu", 5), ("Item", "", 6)], "k string, v string, n int")
    raw = studies.site_hierarchy(urls, sites, tags, menu)
    assert {tuple(r) for r in raw.collect()} == {("a.org", "About us", "Staff"), ("b.org", "Homepage", "News"), ("a.org", "Menu", "Item")}
    named = studies.site_hierarchy(urls, sites, tags, menu, terms)
    assert {tuple(r) for r in named.collect()} == {("a.org", "About", "People"), ("b.org", "Homepage", "News")}
    taxonomy = spark.createDataFrame([("Homepage", "About"), ("About", "People"), ("Homepage", "News")], "hypernym string, hyponym string")
    out = studies.site_structure(named, taxonomy, k=2)
    assert {r["sitedomain"]: (round(r["recall"], 6), r["missing"]) for r in out["scores"].collect()} == {"a.org": (0.666667, 1), "b.org": (0.333333, 2)}
    assert out["clusters"].select("cluster").distinct().count() == 2
    assert out["first_level"].count() == 4


def test_languages_and_main_category(spark):
    df = spark.createDataFrame([("France", None), ("Peru", "own"), ("Nowhere", "")], "country string, language string")
    words = spark.createDataFrame([("france", "French", "fr"), ("Peru", "Spanish", "es")], "country string, language string, language_code string")
    assert {(r["country"], r["language"], r["language_code"]) for r in academies.with_language(df, words).collect()} == {("France", "French", "fr"), ("Peru", "own", "es"), ("Nowhere", None, None)}
    page = '<div><p>Intro <a title="Category:No" href="/no">x</a></p><p>Main category: <a href="/wiki/C" title="Category:Yes">y</a></p></div>'
    rows = academies.main_category(spark.createDataFrame([("u", page), ("v", "<p>none</p>")], "url string, html string"), "url", "html").collect()
    assert [tuple(r) for r in rows] == [("u", "Category:Yes", "/wiki/C")]
