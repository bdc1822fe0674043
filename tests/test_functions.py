from pyspark.sql import functions as F

from scriptorium.functions import multivalue as M
from scriptorium.functions import stats as S
from scriptorium.functions import text as X
from scriptorium.functions import urls as U
from scriptorium.functions import years as Y


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column(F.col("c")).alias("x")).first()["x"]


def test_text(spark):
    assert one(spark, " \t a ", X.strip) == "a"
    assert [one(spark, v, X.is_missing_like) for v in (None, " N/A ", "-", "nan", "x")] == [True, True, True, True, False]
    assert one(spark, "<b>A &amp;\n B</b><br>c", X.text_of_html) == "A & B c"
    assert one(spark, " Académie (des) Sciences-Lettres ", X.normalize_text) == "academie des sciences lettres"
    assert one(spark, "a\nb​  c", X.clean_text) == "ab c"
    assert one(spark, "Title / by someone / else", X.without_responsibility) == "Title"
    assert one(spark, "Zeitschrift für: X / Y", X.link_title) == "zeitschrift für x"
    assert one(spark, "x" * 60, X.middle_ellipsis) == "x" * 27 + "…" + "x" * 28
    assert one(spark, None, X.middle_ellipsis) == ""
    assert one(spark, None, lambda c: X.contains_any(c, ["a"])) is False
    assert one(spark, "C++ (x)", lambda c: X.contains_any(c, ["c++ ("])) is True


def test_years(spark):
    def span(v, f=Y.published_span):
        return tuple(one(spark, v, f))

    assert span("1914-1920") == (1914, 1920, False)
    assert span("1990-") == (1990, 2025, True)
    assert span("[1990]-") == (1990, 1990, False)
    assert span("1950-1940") == (1950, 1950, False)
    assert span(None) == (None, None, False)
    assert span("no year") == (None, None, False)
    assert span("[1990]-", Y.stated_years) == (1990, 1990, True)
    assert span("1990?-", Y.stated_years) == (1990, 1990, True)
    assert span("1950-1940", Y.stated_years) == (1950, 1940, False)
    assert [one(spark, v, Y.century) for v in ("1400", "1401", "1500", "2000", "2001", "2101", "x", None)] == [None, "15th", "15th", "20th", "21st", None, None, None]


def test_multivalue(spark):
    assert one(spark, "000; 020|5301, 530 x", M.subject_codes) == ["000", "020", "530"]
    assert one(spark, "A; b |A;", M.bodies) == ["a", "b"]
    assert one(spark, "Old  T / - / new t/ old t", M.related_titles) == ["old t", "new t"]
    assert one(spark, None, M.related_titles) == []


def test_urls(spark):
    assert one(spark, "http://a.org:80/x?y", U.domain) == "a.org:80"
    assert [one(spark, v, U.domain_or_null) for v in ("a.org/x", "-", "", None)] == ["a.org", None, None, None]
    assert one(spark, "/a//b.js/ c?x/d.PDF", U.segments) == ["a", "c"]
    assert one(spark, "a%2Fb+c%zz", U.percent_decode) == "a/b+c%zz"
    assert [tuple(p) for p in one(spark, ["a", "b"], U.parent_pairs, "array<string>")] == [("Homepage", "a"), ("a", "b")]
    assert one(spark, "https://a.org/x/y/?q=1/", U.relative) == "/x/y/?q=1"
    assert [one(spark, v, U.is_page) for v in ("/a.json", "/a.js")] == [True, False]
    assert one(spark, "/a.json", lambda c: U.is_page(c, anywhere=True)) is False
    assert one(spark, "<loc> http://a.org/1 </loc> see http://a.org/22 and http://x", U.harvest) == ["http://a.org/1", "http://a.org/22"]
    assert one(spark, 'x <a href="mailto:b@x.org?subject=1"> <a href="mailto:a@x.org">', U.emails) == "a@x.org, b@x.org"
    assert one(spark, "http://e.org/wiki/A_b%20c#x", U.title_of_entity_url) == "A b c"
    found = one(spark, "broken http://a.org/page1 text", U.sitemap_urls)
    assert (found["urls"], found["parsing_method"]) == (["http://a.org/page1"], "regex")
    assert one(spark, "", U.sitemap_urls)["parsing_method"] == "failed"
    links = spark.createDataFrame([('<a href="/x"> <a href="http://o.org/y"> <a href="z">', "http://a.org/p")], "h string, u string")
    assert links.select(U.same_host_links(F.col("h"), F.col("u")).alias("x")).first()["x"] == ["http://a.org/x", "http://a.org/z"]


def test_wilson(spark):
    cases = [(49, 114, 0.3427, 0.5215), (112, 178, 0.5562, 0.6967), (15, 58, 0.1635, 0.3838), (146, 234, 0.5603, 0.6835)]
    df = spark.createDataFrame([c[:2] for c in cases] + [(0, 0)], "k int, n int")
    low, high = S.wilson(F.col("k"), F.col("n"))
    rows = df.select(low.alias("low"), high.alias("high")).collect()
    for row, case in zip(rows, cases, strict=False):
        assert abs(row["low"] - case[2]) < 1e-4 and abs(row["high"] - case[3]) < 1e-4
    assert tuple(rows[-1]) == (None, None)
    p = spark.createDataFrame([(1.959963984540054,), (None,)], "z double").select(S.two_sided_p(F.col("z")).alias("p")).collect()
    assert abs(p[0]["p"] - 0.05) < 1e-9 and p[1]["p"] is None


def test_title_follows_its_sql(spark, tmp_path):
    """Markup in references is a tag, other references stay, a title may hold any line end but a line feed; as the SQL says."""
    import duckdb

    from scriptorium.plans import catalogue

    titles = ["a &lt;b&gt; c", "&#39;x&#39; &amp;lt; &nbsp;y ", "two\rlines", "two\nlines", "  \u0085v\x0bw", "&amp;amp; &eacute;", "<i>t</i>\t\f u ", ""]
    rows = [(i, f"<html><title>{t}</title>") for i, t in enumerate(titles)] + [(98, "no title"), (99, None)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(catalogue.SQL["page_titles"]).fetchall())
    assert sorted((r["page_id"], r["title"]) for r in catalogue.page_titles(spark, str(tmp_path)).collect()) == want
