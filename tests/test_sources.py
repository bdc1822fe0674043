import json

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import fetch, readers, sinks
from scriptorium.streaming import pending

MARC = """<collection xmlns:marc="m"><marc:record><marc:controlfield tag="001">c1</marc:controlfield>
<marc:datafield tag="016"><marc:subfield code="2">DE-101</marc:subfield><marc:subfield code="a">no</marc:subfield></marc:datafield>
<marc:datafield tag="016"><marc:subfield code="2">DE-600</marc:subfield><marc:subfield code="a">0123-4</marc:subfield></marc:datafield>
<marc:datafield tag="710"><marc:subfield code="a">Acad</marc:subfield><marc:subfield code="b">Unit</marc:subfield><marc:subfield code="0">k1</marc:subfield><marc:subfield code="0">k2</marc:subfield></marc:datafield>
<marc:datafield tag="110"><marc:subfield code="a">First</marc:subfield></marc:datafield></marc:record></collection>"""


def test_marc(spark, tmp_path):
    (tmp_path / "r.xml").write_text(MARC)
    records = readers.marc(spark, str(tmp_path / "r.xml"))
    assert [tuple(r) for r in readers.marc_bodies(records).collect()] == [("0123-4", "First", "N/A"), ("0123-4", "Acad (Unit)", "k2")]
    values = readers.marc_values(records).first()["values"]
    assert values["001"] == "c1" and values["016_a"] == "no | 0123-4" and values["710_0"] == "k1 | k2"
    assert readers.marc_columns(readers.marc_values(records), {"110_a": "Body", "245_a": "Title"}).first().asDict() == {"record": records.first()["record"], "Body": "First", "Title": None}


def test_sitemaps(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://a.org/x </loc></url></urlset>')
    (tmp_path / "b.xml").write_bytes(b"\xe9 <loc>http://b.org/caf\xe9 </loc> broken")
    files = readers.whole_files(spark, str(tmp_path), "*.xml")
    mapping = spark.createDataFrame([("A", "a.xml"), ("B", "b.xml"), ("C", "No sitemap")], "site_name string, sitemap_file string")
    got = {r["site_name"]: (r["loc"], r["sitedomain"], r["parsing_method"]) for r in readers.site_urls(files, mapping).collect()}
    assert got["A"] == ("http://a.org/x", "a.org", "standard") and got["B"][2] == "regex" and "C" not in got
    assert [r["loc"] for r in readers.sitemap(spark, str(tmp_path / "a.xml")).collect()] == ["http://a.org/x"]
    sinks.sitemap(spark.createDataFrame([("http://a.org/?a=1&b=2",)], "url string"), str(tmp_path / "out"))
    assert [r["loc"] for r in readers.sitemap(spark, str(tmp_path / "out")).collect()] == ["http://a.org/?a=1&b=2"]


def test_html_table(spark):
    html = '<h2 id="list">L</h2><table><tr><th>Name</th><th>Site</th><th>Founded</th></tr><tr><td colspan="3">Asia</td></tr><tr><td>A &amp; B</td><td><a href="/ab">ab</a></td><td>1900</td></tr><tr><td>x</td></tr></table>'
    rows = readers.table_rows(spark.createDataFrame([(1, html)], "k int, h string"), "k", F.col("h"), "list").collect()
    assert [(r["area"], r["c0"], r["link"]["href"], r["c2"]) for r in rows] == [("Asia", "A & B", "/ab", "1900")]


def test_archive_listing(spark):
    payload = json.dumps([["k", "t", "o"], ["x", "1", "http://a"], ["y", "2", "http://a"], ["z"]])
    rows = readers.archive_listing(spark.createDataFrame([(1, payload)], "k int, p string"), "p", "k").collect()
    assert [tuple(r) for r in rows] == [(1, "http://a")]


def test_retry_and_pages(spark):
    calls, waits = [], []

    def flaky(url, params):
        calls.append(url)
        return (429, "") if len(calls) < 3 else (200, "ok")

    assert fetch.with_retry(flaky, "u", {}, sleep=waits.append) == (200, "ok") and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError):
        fetch.with_retry(lambda u, p: (500, ""), "u", {}, tries=2, sleep=lambda s: None)
    listing = {0: {"items": [{"n": 1}], "next": 1}, 1: {"items": [{"n": 2}], "next": None}}
    got = fetch.continued(lambda u, p: (200, json.dumps(listing[p.get("at", 0)])), "u", {}, lambda x: None if x["next"] is None else {"at": x["next"]}, lambda x: x["items"])
    assert [i["n"] for i in got] == [1, 2]
    pages = fetch.offset_pages(spark, lambda u, p: (200, f"total=250 from {p['startRecord']}"), "u", {}, lambda body: int(body.split("=")[1].split()[0]))
    assert sorted(r["offset"] for r in pages.collect()) == [1, 101, 201]


def test_crawl_and_discovery(spark):
    site = {"http://a.org": '<a href="/1"> <a href="http://b.org/">', "http://a.org/1": '<a href="/2">', "http://a.org/2": '<a href="/3">', "http://a.org/sitemap_index.xml": "<loc>x</loc>"}

    def serve(url, params):
        return (200, site[url]) if url in site else (404, "")

    sites = spark.createDataFrame([("http://a.org",)], "site string")
    assert sorted((r["url"], r["depth"]) for r in fetch.crawl(sites, "site", serve, most_depth=2).collect()) == [("http://a.org", 0), ("http://a.org/1", 1), ("http://a.org/2", 2)]
    assert fetch.crawl(sites, "site", serve, most_pages=2).count() == 2
    assert fetch.discovered(sites, "site", serve).first()["url"] == "http://a.org/sitemap_index.xml"


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([("Homepage", "b"), ("Homepage", "a"), ("a", "c"), ("c", "a")], "parent string, child string")
    assert sinks.markdown_taxonomy(edges) == "# Taxonomy\n\n## Homepage\n- a\n  - c\n- b\n"
    assert sinks.p_text(0.0004) == "< 0.001" and sinks.median_text(None) == "NR"
    assert r"a\_b & < 0.001 \\" in sinks.latex([{"x": "a_b", "p": 0.0001}], {"x": "Name", "p": "p"}, {"p": sinks.p_text})
    log = sinks.Processed(spark, str(tmp_path / "log"))
    df = spark.createDataFrame([("u",), ("v",)], "url string")
    log.add(df.where("url = 'u'"), "done")
    assert [r["url"] for r in log.skip(df).collect()] == ["v"]
    point = sinks.Checkpoint(spark, str(tmp_path / "point"), {"depth": 2})
    assert point.load() is None
    point.save(1, seen=df)
    step, tables = point.load()
    assert step == 1 and tables["seen"].count() == 2
    assert sinks.Checkpoint(spark, str(tmp_path / "point"), {"depth": 3}).load() is None


def test_stream_hands_each_key_over_once(spark, tmp_path):
    seen = []
    take = lambda df, _: seen.extend(r["url"] for r in df.collect())
    spark.createDataFrame([("u",), ("u",)], "url string").write.parquet(str(tmp_path / "in"))
    pending.handle_new(spark, str(tmp_path / "in"), "url string", str(tmp_path / "c"), take)
    spark.createDataFrame([("u",), ("v",)], "url string").write.mode("append").parquet(str(tmp_path / "in"))
    pending.handle_new(spark, str(tmp_path / "in"), "url string", str(tmp_path / "c"), take)
    assert sorted(seen) == ["u", "v"]


def test_workbook_and_summary_table(spark, tmp_path):
    import zipfile
    from xml.etree import ElementTree

    one = spark.createDataFrame([("a & <b>", 1, 0.5, True), (None, 2, float("nan"), False)], "name string, n int, x double, yes boolean")
    sinks.workbook({"First": one, "Second & last": one.select("n")}, str(tmp_path / "book.xlsx"), widths={"name": 40})
    file = zipfile.ZipFile(tmp_path / "book.xlsx")
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    sheet = ElementTree.fromstring(file.read("xl/worksheets/sheet1.xml"))
    assert [["".join(c.itertext()) for c in row] for row in sheet.iterfind(".//m:row", space)] == [["name", "n", "x", "yes"], ["a & <b>", "1", "0.5", "1"], ["", "2", "", "0"]]
    assert sheet.find(".//m:col", space).get("width") == "40"
    assert [s.get("name") for s in ElementTree.fromstring(file.read("xl/workbook.xml")).iterfind(".//m:sheet", space)] == ["First", "Second & last"]
    with pytest.raises(ValueError, match="more than 1 rows"):
        sinks.workbook({"x": one}, str(tmp_path / "no.xlsx"), most=1)
    row = {f"{c}_{s}": v for s in "ab" for c, v in {"n": 10, "events": 4, "censored": 6, "median": None if s == "a" else 42.0, "s_25": 0.5, "s_50": 1.2, "s_100": 0.1, "rmst": 33.33}.items()}
    row |= {"rmst_difference": 1.0, "rmst_low": -0.5, "rmst_high": 2.0, "rmst_p": 0.0004, "logrank_p": 0.25, "stratified_p": None}
    text = sinks.summary_table([("Engineering vs.\\ non-engineering", "Engineering", "Non-engineering", row)])
    assert r"Engineering & 10 & 4 & 6 & -- & 0.50 & 1.00 & 0.10 & 33.3 \\" in text and r"Log-rank $p$} & 0.250 \\" in text
    assert r"1.0 [-0.5, 2.0]; boot $p$=$<0.001$ \\" in text and text.count(r"\midrule") == 1 and r"$\tau=100$ years" in text
