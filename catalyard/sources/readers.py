"""Readers of catalogue sources: CSV, registry XML, Markdown tables and product pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sanitize_xml, split_product_name, strip_ws, text, title_case
from .csv import read_csv

#: The tags of a registry grant.
GRANT_FIELDS = [
    "applicant_name", "address", "city", "state", "country", "zip_code", "fcc_id", "application_purpose", "grant_date",
    "lower_freq_mhz", "upper_freq_mhz",
]


def read_catalog_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, place: str | None = None) -> DataFrame:
    """CSV files with headers, all strings: columns by name, short rows filled, missing values empty, as ``read_csv`` does."""
    return read_csv(spark, path, columns=columns, place=place)


#: The unreadable records of ``_rows``.
BAD = "bad_record"


def _in_file_order(df: DataFrame) -> Column:
    """Sorts rows by file, then by their place in it, however files are split and dealt."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def _rows(spark: SparkSession, path: str, fields: Sequence[str], encoding: str) -> DataFrame:
    """A record for each ``<Row>``, its place (``at``), and its text if it can't be read (BAD).

    Files are split at the end tags, so a large one is read by many tasks; ``encoding`` is any that extends ASCII.
    """
    raw = spark.read.option("lineSep", "</Row>").text(path)
    raw = raw.select(F.decode(F.col("value").cast("binary"), encoding).alias("value"), _in_file_order(raw).alias("at"))
    body = F.concat(F.regexp_extract(sanitize_xml(F.col("value")), r"(?s)<Row>(.*)$", 0), F.lit("</Row>"))
    schema = T.StructType([T.StructField(f, T.StringType()) for f in (*fields, BAD)])
    record = F.from_xml(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    found = raw.where(F.contains("value", F.lit("<Row>"))).select(record.alias("r"), "at")
    return found.select(*(strip_ws(F.col(f"r.{f}")).alias(f) for f in fields), F.col(f"r.{BAD}").alias(BAD), "at")


def read_grants_xml(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Registry grants, a row for each ``<Row>``; absent or empty tags are empty, bare ampersands are taken as such.
    Records that aren't XML are left out: ``read_bad_grants`` has them."""
    return _rows(spark, path, GRANT_FIELDS, encoding).where(F.col(BAD).isNull()).select(*GRANT_FIELDS)


def read_bad_grants(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(bad_record) of the records that ``read_grants_xml`` leaves out."""
    return _rows(spark, path, GRANT_FIELDS, encoding).where(F.col(BAD).isNotNull()).select(BAD)


def read_grantee_map(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(code, name), one row for each code, the last by file and place in it; blank codes are dropped."""
    rows = _rows(spark, path, ["grantee_code", "grantee_name"], encoding)
    return rows.where("grantee_code <> ''").groupBy(F.col("grantee_code").alias("code")).agg(F.max_by("grantee_name", "at").alias("name"))


def read_markdown_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """Data rows of a Markdown table, with ``at``, their place. Columns are named by its header, or by ``columns``; each file may
    repeat the header. compat: empty cells are left out, so that later cells move to the left, and any line with ``---``
    is dropped; else cells stay in place and only separator rows are dropped."""
    raw = spark.read.text(path)
    lines = raw.select(strip_ws(F.col("value")).alias("line"), _in_file_order(raw).alias("at")).where("line like '|%'")
    drop = F.contains("line", F.lit("---")) if compat else F.col("line").rlike(r"^\|[\s:|-]*-[\s:|-]*$")
    lines = lines.where(~drop)
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), strip_ws)
    if compat:
        cells = F.filter(cells, lambda c: c != "")
    head = lines.agg(F.min_by(F.struct("line", cells.alias("cells")), "at").alias("h")).first().h  # one row
    names = list(columns or (head.cells if head else []))
    rows = lines.where(F.col("line") != F.lit(head.line)) if head else lines
    return rows.select("at", cells.alias("c")).select("at", *(text(F.get("c", F.lit(i))).alias(c) for i, c in enumerate(names)))


class _Tables(HTMLParser):
    """The tables of a page as (class, rows of (tag, text, first link's text)), and all links as (href, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list = []
        self.links: list = []
        self._cell = self._link = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attrs = dict(attrs)
        if tag == "table":
            self.tables.append(((attrs.get("class") or "").split(), []))
        elif tag == "tr" and self.tables:
            self.tables[-1][1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1][1]:
            self._cell = [tag, "", None]
            self.tables[-1][1][-1].append(self._cell)
        elif tag == "a":
            self._link = [attrs.get("href") or "", "", bool(self._cell)]
            self.links.append(self._link)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self._link:
            if self._cell and self._cell[2] is None:
                self._cell[2] = self._link[1].strip()
            self._link = None
        elif tag in ("td", "th", "tr", "table"):
            self._cell = None

    def handle_data(self, data: str) -> None:
        if self._cell:
            self._cell[1] += data
        if self._link:
            self._link[1] += data


def _parsed(html: str | None) -> _Tables:
    p = _Tables()
    p.feed(html or "")
    return p


def parse_product_table(pages: DataFrame, brands: Sequence[str]) -> DataFrame:
    """Products of ``pages`` (page_id, html): rows with five cells and a link in the first of the first ``table.table``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page_id, html in zip(pdf["page_id"], pdf["html"]):
                table = next((rows for cls, rows in _parsed(html).tables if "table" in cls), [])
                for row in table:
                    cells = [c for c in row if c[0] == "td"]
                    if len(cells) >= 5 and cells[0][2] is not None:
                        out.append((page_id, cells[0][2], *(c[1].strip() for c in cells[1:5])))
            yield pd.DataFrame(out, columns=["page_id", "product_name", "reviews", "last_review", "msrp", "rating_text"])

    raw = pages.select("page_id", "html").mapInPandas(run, "page_id long, product_name string, reviews string, last_review string, msrp string, rating_text string")
    parts = split_product_name(F.col("product_name"), brands)
    rating = F.regexp_extract("rating_text", r"\(([\d.]+)\)", 1)
    return raw.withColumn("rating", rating).withColumn("manufacturer", title_case(parts.manufacturer)).withColumn("model", parts.model)


def extract_named_column(pages: DataFrame, header: str, link_part: str) -> DataFrame:
    """(page_id, name): the column under the first header that contains ``header``; without one, link texts in rows; without
    those, texts of links whose address contains ``link_part``. Fallbacks take texts of over three characters."""

    def names(html: str | None) -> list[str]:
        p = _parsed(html)
        for _, rows in p.tables:
            for row in rows:
                at = next((i for i, c in enumerate(row) if c[0] == "th" and header in c[1]), None)
                if at is not None:
                    found = [r[at][1].strip() for r in rows if len(r) > at and r[at][0] == "td"]
                    return [x for x in found if x]
        inside = [x[1].strip() for x in p.links if x[2]]
        return [x for x in inside if len(x) > 3] or [t.strip() for h, t, _ in p.links if link_part in h and len(t.strip()) > 3]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "names": [names(h) for h in pdf["html"]]})

    found = pages.select("page_id", "html").mapInPandas(run, "page_id long, names array<string>")
    return found.select("page_id", F.explode("names").alias("name"))


def link_texts(pages: DataFrame, link_part: str) -> DataFrame:
    """(page_id, name) of links whose address contains ``link_part``: the built-in form of the last fallback."""
    links = F.regexp_extract_all("html", F.lit(r'(?is)<a\b[^>]*href="[^"]*' + link_part + r'[^"]*"[^>]*>([^<]*)</a>'), 1)
    return pages.select("page_id", F.explode(links).alias("name")).withColumn("name", F.trim("name")).where("length(name) > 3")


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
