"""Results to files: Parquet, CSV, sitemaps, MARC, Markdown and LaTeX, and logs of what is done."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def csv(df: DataFrame, path: str, separator: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", separator).option("escape", '"').csv(path)


def sitemap(urls: DataFrame, path: str, url: str = "url") -> None:
    """<urlset> files of <url><loc>; texts are escaped by the writer."""
    urls.select(F.col(url).alias("loc")).write.mode("overwrite").format("xml").option("rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"').option("rowTag", "url").save(path)


def marc(records: DataFrame, path: str) -> None:
    named = records.select(F.col("controlfields").alias("marc:controlfield"), F.col("datafields").alias("marc:datafield"))
    named.write.mode("overwrite").format("xml").option("rootTag", 'collection xmlns:marc="http://www.loc.gov/MARC21/slim"').option("rowTag", "marc:record").save(path)


def markdown_taxonomy(edges: DataFrame, root: str = "Homepage", most: int = 100_000) -> str:
    """Headings and nested lists of the taxonomy (parent, child); roots are Homepage, or what is nobody's child.

    A node on its own path is not entered again. Collects the edges, of which there may be `most`.
    """
    rows = edges.select("parent", "child").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges")
    kids: dict[str, list[str]] = {}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r["child"])
    tops = [root] if root in kids else sorted(set(kids) - {c for v in kids.values() for c in v})
    lines = ["# Taxonomy", ""]
    stack = [(t, 2, (t,)) for t in reversed(tops)]
    while stack:
        node, level, way = stack.pop()
        lines.append(f"## {node}" if level == 2 else f"{'  ' * (level - 3)}- {node}")
        stack += [(c, level + 1, (*way, c)) for c in sorted(kids.get(node, []), reverse=True) if c not in way]
    return "\n".join(lines) + "\n"


def p_text(p: float | None) -> str:
    return "--" if p is None or math.isnan(p) else "< 0.001" if p < 0.001 else f"{p:.3f}"


def number_text(x: float | None, digits: int = 1, none: str = "--") -> str:
    return none if x is None or (isinstance(x, float) and math.isnan(x)) else f"{x:.{digits}f}"


def median_text(m: float | None) -> str:
    return number_text(m, 0, "NR")


ESCAPES = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\\": r"\textbackslash{}"}


def latex(rows: list[dict], headings: dict[str, str], formats: dict[str, object] | None = None) -> str:
    """A tabular of the named columns; formats are functions of a value."""
    formats = formats or {}
    escape = lambda s: "".join(ESCAPES.get(ch, ch) for ch in s)
    cell = lambda row, c: escape(str(formats[c](row[c])) if c in formats else "--" if row[c] is None else str(row[c]))
    body = [" & ".join(cell(r, c) for c in headings) + r" \\" for r in rows]
    return "\n".join([r"\begin{tabular}{" + "l" * len(headings) + "}", r"\hline", " & ".join(map(escape, headings.values())) + r" \\", r"\hline", *body, r"\hline", r"\end{tabular}", ""])


#: The wording of the summary table of two comparisons.
SUMMARY_HEADINGS = ["Group", "$N$", "Events", "Censored", "Median", "$S(25)$", "$S(50)$", "$S(100)$"]
SUMMARY_NOTES = "Median and RMST are reported in years. $S(t)$ denotes the Kaplan--Meier survival probability at year $t$. RMST$({tau})$ is the restricted mean survival time truncated at $\\tau={tau}$ years. $^{{\\mathrm{{a}}}}$ Stratified by journal start-year quintiles (as in the stratified log-rank test)."


def summary_table(panels: list[tuple[str, str, str, dict]], caption: str = "Survival summary of hosted journals.", label: str = "tab:survival_summary", tau: int = 100) -> str:
    """A LaTeX table with a panel for each (title, name of a, name of b, row of two_group_summary): both groups, then tests and the RMST difference."""
    p = lambda x: "$<0.001$" if x is not None and x < 0.001 else number_text(x, 3)
    share = lambda x: number_text(None if x is None else min(1.0, max(0.0, x)), 2)
    line = lambda *cells: " & ".join(cells) + r" \\"
    wide = lambda text, cell: line(rf"\multicolumn{{8}}{{l}}{{{text}}}", cell)
    body: list[str] = []
    for i, (title, *names, row) in enumerate(panels):
        body += [r"\midrule", rf"\multicolumn{{9}}{{l}}{{\textbf{{Panel {chr(65 + i)}. {title}}}}}\\"]
        for side, name in zip("ab", names, strict=True):
            of = lambda c, side=side: row[f"{c}_{side}"]
            body.append(line(name, *[str(int(of(c))) for c in ("n", "events", "censored")], number_text(of("median"), 0), *[share(of(f"s_{t}")) for t in (25, 50, 100)], number_text(of("rmst"))))
        difference = f"{number_text(row['rmst_difference'])} [{number_text(row['rmst_low'])}, {number_text(row['rmst_high'])}]; boot $p$={p(row['rmst_p'])}"
        body += [r"\addlinespace[2pt]", wide("Log-rank $p$", p(row["logrank_p"])), wide(r"Stratified log-rank $p^{\mathrm{a}}$", p(row["stratified_p"])), wide(f"RMST diff ({names[0]}--{names[1]})", difference)]
    head = [r"\begin{table}[t]", r"\centering", rf"\caption{{{caption}}}", rf"\label{{{label}}}", r"\small", r"\setlength{\tabcolsep}{5pt}", r"\begin{tabular}{lrrrrrrrr}", r"\toprule", line(*SUMMARY_HEADINGS, f"RMST$({tau})$")]
    foot = [r"\bottomrule", r"\end{tabular}", r"\vspace{3pt}", r"\begin{minipage}{0.98\linewidth}", r"\footnotesize", r"\textit{Notes:} " + SUMMARY_NOTES.format(tau=tau), r"\end{minipage}", r"\end{table}"]
    return "\n".join([*head, *body, *foot, ""])


def workbook(sheets: dict[str, DataFrame], path: str, widths: dict[str, float] | None = None, most: int = 1_000_000) -> None:
    """A workbook with a sheet for each DataFrame: headings, then rows in the order of the DataFrame; columns as wide as `widths` says (or their heading).

    For tables of display size, written by the driver; a sheet holds at most `most` rows, and more are refused.
    """
    import zipfile
    from xml.sax.saxutils import escape, quoteattr

    def cell(v: object) -> str:
        if v is None or (isinstance(v, float) and not math.isfinite(v)):
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        clean = "".join(ch for ch in str(v) if ch in "\t\n\r" or ord(ch) >= 32)
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'

    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    top = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as file:
        for k, (name, df) in enumerate(sheets.items(), 1):
            rows = df.limit(most + 1).collect()
            if len(rows) > most:
                raise ValueError(f"{name} has more than {most} rows")
            columns = "".join(f'<col min="{i}" max="{i}" width="{(widths or {}).get(c, len(c) + 2)}" customWidth="1"/>' for i, c in enumerate(df.columns, 1))
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [df.columns, *rows])
            file.writestr(f"xl/worksheets/sheet{k}.xml", f'{top}<worksheet xmlns="{main}"><cols>{columns}</cols><sheetData>{body}</sheetData></worksheet>')
        listed = "".join(f'<sheet name={quoteattr(name[:31])} sheetId="{k}" r:id="r{k}"/>' for k, name in enumerate(sheets, 1))
        file.writestr("xl/workbook.xml", f'{top}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        ties = "".join(f'<Relationship Id="r{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        file.writestr("xl/_rels/workbook.xml.rels", f'{top}<Relationships xmlns="{package}/relationships">{ties}</Relationships>')
        file.writestr("_rels/.rels", f'{top}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kind}.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        file.writestr("[Content_Types].xml", f'{top}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')


class Processed:
    """A table of keys that are done: skip them, and append what a run has done."""

    def __init__(self, spark: SparkSession, path: str, key: str = "url"):
        self.spark, self.path, self.key = spark, path, key
        spark.createDataFrame([], f"{key} string, action string, at timestamp").write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.key} string, action string, at timestamp").parquet(self.path)

    def skip(self, df: DataFrame) -> DataFrame:
        return df.join(self.read(), self.key, "left_anti")

    def add(self, df: DataFrame, action: str) -> None:
        df.select(F.col(self.key).cast("string"), F.lit(action).alias("action"), F.current_timestamp().alias("at")).write.mode("append").parquet(self.path)


class Checkpoint:
    """State of an iteration as tables and a manifest that names its parameters: it resumes only with the same ones."""

    VERSION = 1

    def __init__(self, spark: SparkSession, path: str, parameters: dict):
        self.spark, self.path, self.parameters = spark, path.rstrip("/"), parameters

    def save(self, step: int, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/step={step}/{name}")
        told = json.dumps({"version": self.VERSION, "step": step, "parameters": self.parameters, "tables": sorted(tables)}, sort_keys=True)
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/manifest")

    def load(self) -> tuple[int, dict[str, DataFrame]] | None:
        """The last step with its tables; None if there is none for these parameters."""
        try:
            told = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/manifest").collect()]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        same = [t for t in told if t["version"] == self.VERSION and t["parameters"] == self.parameters]
        if not same:
            return None
        last = max(same, key=lambda t: t["step"])
        return last["step"], {n: self.spark.read.parquet(f"{self.path}/step={last['step']}/{n}") for n in last["tables"]}
