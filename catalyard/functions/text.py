"""Column functions that clean and compose catalogue text. Built-in Spark functions only."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def text(c: Column) -> Column:
    """Missing text is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_ws(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text(c), f"^{_SPACE}+|{_SPACE}+$", "")


def blank(df: DataFrame, column: str) -> Column:
    """Null, empty, or the number zero, by the column's type. White space and the text 0 are not blank."""
    c = F.col(column)
    return c.isNull() | ((c == 0) if isinstance(df.schema[column].dataType, T.NumericType) else (c.cast("string") == ""))


def title_case(c: Column) -> Column:
    """Stripped, each run of letters with a capital first letter: a hyphen or digit starts a new word."""
    runs = F.regexp_extract_all(F.lower(strip_ws(c)), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substr(r, F.lit(1), F.lit(1))), F.substr(r, F.lit(2)))), "")


def normalize_model(c: Column) -> Column:
    return F.upper(strip_ws(c))


def parse_year(c: Column) -> Column:
    """``2014.0`` is 2014; text without digits is null; so is what ``bad_year`` reports."""
    return F.when(c.rlike(r"^[0-9.]*[0-9][0-9.]*$"), c.try_cast("double").try_cast("int"))


def bad_year(c: Column) -> Column:
    """Digits and dots that are no number."""
    return F.coalesce(c.rlike(r"^[0-9.]*[0-9][0-9.]*$"), F.lit(False)) & parse_year(c).isNull()


def parse_battery(c: Column) -> Column:
    """The first run of digits."""
    return F.nullif(F.regexp_extract(text(c), "[0-9]+", 0), F.lit("")).try_cast("int")


#: What is cut off the name of a known maker's product, in this order.
PRODUCT_JUNK = [
    r"^\s*[-–]\s*",
    r"\s*\(.*?\)$",
    r"(?i)\s+dual band.*$",
    r"\s+–.*$",
    r"(?i)\s+vhf.*$",
]


def split_product_name(name: Column, brands: Sequence[str]) -> Column:
    """struct(manufacturer, model). Two makers of two words are found anywhere in a name, then the joint brand, then the
    first of ``brands`` at the start (as the name spells it, whatever its case), then the first word."""
    name = strip_ws(name)
    pattern = "(?i)^(" + "|".join(re.escape(b) for b in brands) + r")(?![\p{L}\p{N}_])"
    hit = F.regexp_extract(name, pattern, 1)
    rest = strip_ws(F.substr(name, F.length(hit) + 1))
    for junk in PRODUCT_JUNK:
        rest = F.regexp_replace(rest, junk, "")

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("manufacturer"), strip_ws(b).alias("model"))

    split = pair(F.regexp_extract(name, r"^(\S+)\s+", 1), F.regexp_extract(name, r"(?s)^\S+\s+(.*)$", 1))
    out = F.when(hit != "", pair(hit, rest)).when(name.rlike(r"^\S+\s+"), split).otherwise(pair(name, F.lit("")))
    joint = name.contains("Baofeng/Pofung") | name.contains("BaoFeng/Pofung")
    out = F.when(joint, pair(F.lit("Baofeng"), F.regexp_replace(name, r"(?i)^baofeng/pofung\s+", ""))).otherwise(out)
    for maker in ("Connect Systems", "Radio Shack"):
        out = F.when(name.contains(maker), pair(F.lit(maker), F.replace(name, F.lit(maker), F.lit("")))).otherwise(out)
    return out


def clean_code(model: Column) -> Column:
    """A model as it stands in a registry id: no parentheses, white space or signs but the hyphen; upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(text(model), r"\([^)]*\)", ""), "[^A-Za-z0-9-]", ""))


def make_id(code: Column, model: Column) -> Column:
    """``code-MODEL``; null if either part is blank."""
    return F.when((text(code) != "") & (clean_code(model) != ""), F.concat(code, F.lit("-"), clean_code(model)))


def split_id(c: Column) -> Column:
    """struct(code, product) around the first hyphen; without one, both are empty."""
    parts = F.split(text(c), "-", 2)
    cut = F.size(parts) == 2
    return F.struct(F.when(cut, parts[0]).otherwise("").alias("code"), F.when(cut, parts[1]).otherwise("").alias("product"))


def sanitize_xml(c: Column) -> Column:
    """A bare ``&`` is written out."""
    return F.regexp_replace(c, r"&(?!(?:(?:amp|lt|gt|quot|apos)\b|#))", "&amp;")


def strip_code_prefix(c: Column, code: Column) -> Column:
    """What follows the code, without leading hyphens and outer white space."""
    cut = F.when(F.startswith(c, code), F.substr(c, F.length(code) + 1)).otherwise(c)
    return strip_ws(F.regexp_replace(cut, "^-+", ""))


def compose_id(code: Column, model: Column) -> Column:
    return F.when(model.contains("-"), F.concat(code, F.lit("-"), model)).otherwise(F.concat(code, model))


def frequency(c: Column) -> Column:
    """A limit in MHz; null if it is no number."""
    return F.when(c.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"), F.trim(c).try_cast("double"))


def bands_between(lo: Column, hi: Column) -> Column:
    """Sorted array of the bands HF (to 30 MHz), VHF (to 300) and UHF (to 1000) that a range touches; empty if a limit is null.

    Both limits are used often: project ``frequency`` first (``with_bands``), or it is computed as often."""

    def touches(a: float, b: float) -> Column:
        return ((lo < b) & (hi > a)) | ((lo <= b) & (hi >= b)) | ((lo >= a) & (hi <= b))

    hf = (lo < 30) | (hi <= 30) | ((lo <= 30) & (hi >= 30))
    found = F.array(*(F.when(t, F.lit(n)) for n, t in (("HF", hf), ("UHF", touches(300, 1000)), ("VHF", touches(30, 300)))))
    return F.coalesce(F.when(lo.isNotNull() & hi.isNotNull(), F.array_compact(found)), F.array().cast("array<string>"))


def with_bands(df: DataFrame, lower: str, upper: str, name: str = "bands") -> DataFrame:
    """``df`` with the bands between two text columns; each limit is read once."""
    read = df.withColumns({"_lo": frequency(F.col(lower)), "_hi": frequency(F.col(upper))})
    return read.withColumn(name, bands_between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def grant_note(date: Column, purpose: Column, lower: Column, upper: Column) -> Column:
    return F.format_string("FCC Grant Date: %s; Purpose: %s; Freq: %s-%s MHz", text(date), text(purpose), text(lower), text(upper))


def product_label(brand: Column, model: Column) -> Column:
    return F.concat(text(brand), F.lit(" "), text(model))


def brand_label(name: Column, code: Column) -> Column:
    return F.concat(text(name), F.lit(" ("), text(code), F.lit(")"))


def default_if_blank(c: Column, default: str) -> Column:
    return F.when(text(c) == "", F.lit(default)).otherwise(c.cast("string"))


def search_url(base: str, brand: Column, model: Column) -> Column:
    """A search link; a space is ``%20`` and ``/`` stays."""
    coded = F.url_encode(product_label(brand, model))
    return F.concat(F.lit(base), F.replace(F.replace(coded, F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")))


def registry_url(base: str, code: Column, product: Column) -> Column:
    return F.when((text(code) != "") & (text(product) != ""), F.concat(F.lit(base), code, product))


def import_message(code: Column, name: Column, total: Column, created: Column, updated: Column, skipped: Column) -> Column:
    """What an import did: the grantee, the number of records, and the counts that aren't zero (wordings are fixed values)."""
    head = F.format_string("Grantee %s (%s): Processed %s records", text(code), text(name), total.cast("string"))
    said = {"new radios added": created, "existing radios updated": updated, "duplicates skipped": skipped}
    return F.concat_ws(" • ", head, *(F.when(n != 0, F.concat(n.cast("string"), F.lit(f" {what}"))) for what, n in said.items()))
