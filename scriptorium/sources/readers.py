"""Tables from files: Parquet, CSV, text, HTML, sitemaps, MARC XML, workbooks at the edge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import squeeze, strip, text_of_html
from ..functions.urls import domain, sitemap_urls

SUBFIELD = T.StructType([T.StructField("_code", T.StringType()), T.StructField("_VALUE", T.StringType())])
MARC = T.StructType(
    [
        T.StructField("marc:controlfield", T.ArrayType(T.StructType([T.StructField("_tag", T.StringType()), T.StructField("_VALUE", T.StringType())]))),
        T.StructField("marc:datafield", T.ArrayType(T.StructType([T.StructField("_tag", T.StringType()), T.StructField("marc:subfield", T.ArrayType(SUBFIELD))]))),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    reader = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet of a workbook, as texts; read on the driver, and only where openpyxl is installed."""
    frame = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), T.StructType([T.StructField(c, T.StringType()) for c in frame.columns]))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("url")).where("url <> ''")


def whole_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(file, text) of each file; bytes that are no UTF-8 are read as Latin-1."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), decoded(F.col("content")).alias("text"))


@pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: by their byte order mark, as UTF-8, else as Latin-1, which takes any byte."""

    def one(b: bytes) -> str:
        for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if b.startswith(mark):
                return b.decode(name, "ignore")
        try:
            return b.decode("utf-8")
        except UnicodeDecodeError:
            return b.decode("latin-1")

    return content.map(one, na_action="ignore")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc) of well-formed sitemaps."""
    schema = T.StructType([T.StructField("loc", T.StringType())])
    return spark.read.format("xml").option("rowTag", "url").schema(schema).load(path).select(strip(F.col("loc")).alias("loc")).where("loc <> ''")


def site_urls(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """(site_name, loc, sitedomain, parsing_method) from (file, text) and a mapping (site_name, sitemap_file); sites without a sitemap have no row."""
    named = mapping.where(~F.col("sitemap_file").eqNullSafe(F.lit("No sitemap"))).join(files, F.col("sitemap_file") == F.col("file"))
    locs = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"(?s)<url>.*?<loc>([^<]+)</loc>.*?</url>"), F.lit(1)), strip), lambda x: x != "")
    parsed = named.select("site_name", sitemap_urls(F.col("text"), locs).alias("p"))
    return parsed.select("site_name", F.explode("p.urls").alias("loc"), F.col("p.parsing_method").alias("parsing_method")).select("site_name", "loc", domain(F.col("loc")).alias("sitedomain"), "parsing_method").dropDuplicates(["site_name", "loc"])


def marc(spark: SparkSession, path: str) -> DataFrame:
    """(record, controlfields, datafields); the schema is declared, so that a tag such as 016 keeps its zero."""
    raw = spark.read.format("xml").option("rowTag", "marc:record").schema(MARC).load(path)
    return raw.select(F.monotonically_increasing_id().alias("record"), F.col("`marc:controlfield`").alias("controlfields"), F.col("`marc:datafield`").alias("datafields"))


def marc_values(records: DataFrame, by: str = " | ") -> DataFrame:
    """(record, values): a map from tag, or tag_code, to its texts, those of a repeated one joined in order."""
    none = F.array()
    control = F.transform(F.coalesce("controlfields", none.cast(dict_type(records, "controlfields"))), lambda c: F.struct(c["_tag"].alias("k"), c["_VALUE"].alias("v")))
    data = F.flatten(F.transform(F.coalesce("datafields", none.cast(dict_type(records, "datafields"))), lambda d: F.transform(F.coalesce(d["marc:subfield"], none.cast("array<struct<_code:string,_VALUE:string>>")), lambda s: F.struct(F.concat_ws("_", d["_tag"], s["_code"]).alias("k"), s["_VALUE"].alias("v")))))
    pairs = F.filter(F.concat(control, data), lambda p: p["v"].isNotNull() & (p["v"] != ""))
    # Each step is a column of its own: in a lambda it would be made again for every key.
    told = records.select("record", pairs.alias("__pairs"))
    told = told.select("record", F.col("__pairs.k").alias("__ks"), F.col("__pairs.v").alias("__vs"))
    told = told.select("record", "__ks", "__vs", F.array_distinct("__ks").alias("__keys"))
    joined = lambda k: F.array_join(F.filter("__vs", lambda v, i: F.get("__ks", i) == k), by)
    values = F.when(F.size("__keys") == F.size("__ks"), F.col("__vs")).otherwise(F.transform("__keys", joined))
    return told.select("record", F.map_from_arrays("__keys", values).alias("values"))


def dict_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def marc_columns(values: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Columns of the named keys, under their headers; absent ones are null."""
    return values.select("record", *[F.try_element_at("values", F.lit(k)).alias(h) for k, h in headers.items()])


def marc_bodies(records: DataFrame) -> DataFrame:
    """(zdb_id, corporate_body, koeref): bodies of the tags 110, 710 and 610, in this order, units in brackets."""
    parts = lambda d, code: F.filter(d["marc:subfield"], lambda s: s["_code"] == code)
    last = lambda xs: F.try_element_at(F.transform(xs, lambda s: s["_VALUE"]), F.lit(-1))
    own = F.filter("datafields", lambda d: (d["_tag"] == "016") & (last(parts(d, "2")) == "DE-600") & last(parts(d, "a")).isNotNull())
    zdb = F.coalesce(F.try_element_at(F.transform(own, lambda d: last(parts(d, "a"))), F.lit(1)), F.lit("N/A"))
    name = lambda d: F.array_join(F.transform(F.filter(d["marc:subfield"], lambda s: s["_code"].isin("a", "b")), lambda s: F.when(s["_code"] == "b", F.concat(F.lit("("), s["_VALUE"], F.lit(")"))).otherwise(s["_VALUE"])), " ")
    of_tag = lambda t: F.filter("datafields", lambda d: d["_tag"] == t)
    tagged = F.flatten(F.array(*[of_tag(t) for t in ("110", "710", "610")]))
    rows = F.transform(tagged, lambda d: F.struct(name(d).alias("corporate_body"), F.coalesce(last(parts(d, "0")), F.lit("N/A")).alias("koeref")))
    return records.select(zdb.alias("zdb_id"), F.explode(F.filter(rows, lambda r: r["corporate_body"] != "")).alias("r")).select("zdb_id", "r.*")


def archive_listing(df: DataFrame, payload: str, key: str) -> DataFrame:
    """(key, url): distinct original urls of a listing's JSON rows, whose first row holds the headings."""
    rows = F.from_json(payload, "array<array<string>>")
    body = F.filter(F.slice(rows, 2, F.greatest(F.lit(0), F.size(rows) - 1)), lambda r: F.size(r) >= 3)
    return df.select(key, F.explode(F.array_distinct(F.transform(body, lambda r: F.get(r, F.lit(2))))).alias("url"))


def table_rows(pages: DataFrame, key: str, html: str, anchor: str, columns: int = 3, header: str = "founded") -> DataFrame:
    """(key, position, area, cells, link, link_text) of the first table after an anchor's name.

    A row of one cell that spans all columns names the area of those below; rows with another number of
    cells and the heading are left out. Links are those of the second cell.
    """
    after = F.regexp_extract(html, rf'(?is)(?:id|name)\s*=\s*"{anchor}".*?(<table.*?</table>)', 1)
    each = pages.select(key, after.alias("t")).select(key, F.posexplode(F.regexp_extract_all("t", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("position", "row"))
    cells = F.regexp_extract_all("row", F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    told = each.select(key, "position", F.when(F.col("row").rlike(rf'(?i)colspan\s*=\s*"?{columns}'), text_of_html(F.col("row"))).alias("named"), cells.alias("raw"))
    filled = told.withColumn("area", F.last("named", ignorenulls=True).over(Window.partitionBy(key).orderBy("position")))
    kept = filled.where(F.col("named").isNull() & (F.size("raw") == columns))
    out = kept.select(key, "position", "area", *[text_of_html(F.get("raw", F.lit(i))).alias(f"c{i}") for i in range(columns)], anchor_of(F.get("raw", F.lit(1))).alias("link"))
    return out.where(F.lower("c0") != header).where(F.lower(f"c{columns - 1}") != header)


def anchor_of(cell: Column) -> Column:
    """(text, href) of the first anchor of a cell."""
    return F.struct(squeeze(F.regexp_replace(F.regexp_extract(cell, "(?is)<a[^>]*>(.*?)</a>", 1), "<[^>]*>", " ")).alias("text"), F.regexp_extract(cell, r'(?is)<a[^>]*href="([^"]*)"', 1).alias("href"))
