"""What is particular to academies: countries, transnational bodies, hosts of journals, languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, country_key, is_missing_like, or_empty
from .frames import append_absent, first_per_key, require_columns
from .rates import development_class, engineering_flag

#: Country names as they are written in rosters, and as the statistical standard has them.
COUNTRY_ALIASES = {
    "australian": "Australia",
    "german": "Germany",
    "romanian": "Romania",
    "tunisian": "Tunisia",
    "nicaraguan": "Nicaragua",
    "palestine": "State of Palestine",
    "bolivia": "Bolivia (Plurinational State of)",
    "north korea": "Democratic People's Republic of Korea",
    "south korea": "Republic of Korea",
    "czech republic": "Czechia",
    "moldova": "Republic of Moldova",
    "russia": "Russian Federation",
    "vatican": "Holy See",
    "vatican city": "Holy See",
    "república dominicana": "Dominican Republic",
    "republica dominicana": "Dominican Republic",
    "tanzania": "United Republic of Tanzania",
    "iran": "Iran (Islamic Republic of)",
    "venezuela": "Venezuela (Bolivarian Republic of)",
    "vietnam": "Viet Nam",
    "united states": "United States of America",
    "united kingdom": "United Kingdom of Great Britain and Northern Ireland",
    "türkiye": "Türkiye",
    "kosovo": "Kosovo",
    "republic of the congo": "Republic of the Congo",
}
#: The names that only the roster of host rates knows.
LATER_ALIASES = ("vatican city", "türkiye", "kosovo", "republic of the congo")
#: Academies of no single country.
TRANSNATIONAL = [
    "World Academy of Sciences",
    "ASEAN Academy of Engineering and Technology",
    "World Academy of Art and Science",
    "Academia de Ciências da América Latina",
    "Academia Europaea",
    "African Academy of Sciences",
    "Islamic World Academy of Sciences",
    "Académie des sciences, des arts, des cultures d'Afrique et des diasporas africaines",
]
#: Countries that the classification lacks, with their class.
ADDED_COUNTRIES = [("Kosovo", "Developing"), ("Republic of the Congo", "Developing"), ("Türkiye", "Developing"), ("Turkey", "Developing")]


def canonical_country(c: Column, aliases: dict[str, str] = COUNTRY_ALIASES, first_of_many: bool = True) -> Column:
    """The standard's name of a country, else the name itself; of names parted by ';' the first."""
    name = or_empty(c)
    if first_of_many:
        name = or_empty(F.split_part(name, F.lit(";"), F.lit(1)))
    told = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(told, F.lower(name)), name)


def without_transnational(roster: DataFrame, by_name: bool = True) -> DataFrame:
    """The roster's academies of one country: told by name, or by the roster's own annotation."""
    if by_name:
        return roster.where(~contains_any(F.col("acad_name"), TRANSNATIONAL))
    return roster.where(~F.col("academy_type_annotation").eqNullSafe(F.lit("Transnational Academy")))


def removed_transnational(roster: DataFrame) -> DataFrame:
    return roster.where(contains_any(F.col("acad_name"), TRANSNATIONAL)).select("acad_name").distinct()


def development(countries: DataFrame, added: list[tuple[str, str]] = ADDED_COUNTRIES) -> DataFrame:
    """(country_norm, dev_group) of a classification (country, dev_group), with the added countries that it lacks."""
    own = countries.select(country_key(F.col("country")).alias("country_norm"), development_class(F.col("dev_group")).alias("dev_group")).where("dev_group <> 'Unknown'")
    more = countries.sparkSession.createDataFrame(added, "country string, dev_group string").select(country_key(F.col("country")).alias("country_norm"), "dev_group")
    return first_per_key(append_absent(own, more, "country_norm"), ["country_norm"], ["dev_group"])


def academy_table(roster: DataFrame, countries: DataFrame, hosts: DataFrame) -> DataFrame:
    """(acad_id, is_engineering, dev_group, hosted): the roster with its class, and whether a host record names it."""
    require_columns(hosts, ["koeRef", "acad_id"], "the host table")
    flags = hosts.where(~is_missing_like(F.col("koeRef"))).select(F.trim("acad_id").alias("acad_id")).distinct().withColumn("hosted", F.lit(1))
    own = without_transnational(roster).select(F.trim("acad_id").alias("acad_id"), engineering_flag(F.col("discipline")).alias("is_engineering"), country_key(canonical_country(F.col("country"))).alias("country_norm"))
    joined = own.join(development(countries), "country_norm", "left").join(flags, "acad_id", "left")
    return joined.select("acad_id", "is_engineering", F.coalesce("dev_group", F.lit("Unknown")).alias("dev_group"), F.coalesce("hosted", F.lit(0)).alias("hosted"))


def hosts_of_journals(journals: DataFrame, mapping: DataFrame) -> DataFrame:
    """(acad_id, zdb_id), distinct, through the reference of the corporate body; missing references tie nothing."""
    refs = journals.select(F.trim("ZDB-ID").alias("zdb_id"), F.trim("Source_koeRef").alias("koeRef")).where(~is_missing_like(F.col("koeRef")))
    return refs.join(mapping.select(F.trim("koeRef").alias("koeRef"), F.trim("acad_id").alias("acad_id")), "koeRef").where("acad_id is not null").select("acad_id", "zdb_id").distinct()


def with_language(df: DataFrame, languages: DataFrame, country: str = "country") -> DataFrame:
    """df with blank language and language_code filled from a dictionary (country, language, language_code)."""
    told = languages.select(country_key(F.col("country")).alias("__k"), F.col("language").alias("__l"), F.col("language_code").alias("__c")).dropDuplicates(["__k"])
    joined = df.join(told, country_key(F.col(country)) == F.col("__k"), "left")
    blank = lambda c: F.when(or_empty(F.col(c)) != "", F.col(c)) if c in df.columns else F.lit(None).cast("string")
    keep = [c for c in df.columns if c not in ("language", "language_code")]
    return joined.select(*keep, F.coalesce(blank("language"), "__l").alias("language"), F.coalesce(blank("language_code"), "__c").alias("language_code"))


def main_category(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(url, title, href) of the category that a page's first block naming a 'Main category:' links to; pages without one have no row."""
    block = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<(?:p|div|td)\b[^>]*>((?:(?!</?(?:p|div|td)\b).)*)"), F.lit(1)), lambda b: b.contains("Main category:") & b.rlike(r'<a\b[^>]*title="Category:'))
    link = F.regexp_extract(F.get(block, F.lit(0)), r'(?is)(<a\b[^>]*title="Category:[^>]*>)', 1)
    return pages.select(url, F.regexp_extract(link, 'title="([^"]*)"', 1).alias("title"), F.regexp_extract(link, 'href="([^"]*)"', 1).alias("href")).where("title <> ''")
