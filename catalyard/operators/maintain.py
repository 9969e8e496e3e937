"""Maintenance of catalogue tables: merging makers, prefix clean-up, de-duplication, renames, picked merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, strip_code_prefix, text
from .matching import completeness, most_complete

#: The columns that a merge fills.
MERGE_FIELDS = [
    "fcc_id", "intro_year", "freq_bands_tx", "power_watts", "satellite_tracking", "harmonic_suppression", "gps", "aprs",
    "air_band", "dmr", "display", "battery_mah", "cost_approx", "rebadges_clones", "website", "notes",
]


def joined_notes(mine: Column, other: Column) -> Column:
    """Other notes go below one's own unless they are part of them."""
    new = (text(other) != "") & ~F.contains(text(mine), text(other))
    return F.when(text(mine) == "", text(other)).when(new, F.concat(mine, F.lit("\n"), other)).otherwise(mine)


def merge_brand(radio: DataFrame, source: str, target: str, fields: Sequence[str] = MERGE_FIELDS) -> DataFrame:
    """``radio`` (brand, model, fields, notes) with ``source``'s models moved to ``target``.

    Where the target has the model, its blank fields take the source's values and the source's notes are appended. Rows of
    other brands, or none, stay. (brand, model) is unique in the two brands.
    """
    if source == target:
        raise ValueError("source and target are the same brand")
    cols = [c for c in radio.columns if c not in ("brand", "model")]
    rest = radio.where(F.col("brand").isNull() | ~F.col("brand").isin(source, target))
    s = radio.where(F.col("brand") == source).select("model", *(F.col(c).alias(f"_s_{c}") for c in cols), F.lit(True).alias("_s"))
    t = radio.where(F.col("brand") == target).select("model", *cols, F.lit(True).alias("_t"))
    both = t.join(s, "model", "full_outer")

    def value(c: str) -> Column:
        mine, other = F.col(c), F.col(f"_s_{c}")
        merged = joined_notes(mine, other) if c == "notes" else F.when(blank(radio, c), other).otherwise(mine) if c in fields else mine
        return F.when(F.col("_t").isNull(), other).when(F.col("_s").isNull(), mine).otherwise(merged).alias(c)

    moved = both.select(F.lit(target).alias("brand"), "model", *map(value, cols))
    return rest.unionByName(moved.select(*radio.columns))


def clean_prefix(radio: DataFrame, brand: str, code: str, fields: Sequence[str] = MERGE_FIELDS, order: str = "id") -> DataFrame:
    """``radio`` where models of ``brand`` that begin with ``code`` lose it. Rows that come to one name become one: the
    row that had the name, else the first by model, with blanks filled from the others in that order and notes added.

    One aggregate by name; of the rows of a name only notes are collected, as they all go into the result.
    """
    if not code:
        raise ValueError("a code is needed")
    mine = F.col("brand") == brand
    has = F.startswith(F.col("model"), F.lit(code))
    part = radio.where(mine).withColumn("_name", F.when(has, strip_code_prefix(F.col("model"), F.lit(code))).otherwise(F.col("model")))
    return radio.where(~mine | mine.isNull()).unionByName(fold_prefixed(part.withColumn("_had", has), radio, ["_name"], fields, order))


def fold_prefixed(part: DataFrame, radio: DataFrame, by: Sequence[str], fields: Sequence[str], order: str) -> DataFrame:
    """Rows of ``part`` (columns of ``radio``, _name, _had) that share ``by`` as one, named _name: those that had the name go first."""
    at = F.struct(F.col("_had").alias("had"), "model", order)
    filled = [c for c in fields if c in radio.columns and c != "notes"]
    # Of nothing but blanks the last stays, as each takes the place of the one before.
    first = {c: F.coalesce(F.min_by(F.col(c), F.when(~blank(radio, c), at)), F.max_by(c, at)).alias(f"_f_{c}") for c in filled}
    told = text(F.col("notes")) if "notes" in radio.columns else F.lit("")
    notes = F.sort_array(F.collect_list(F.when(told != "", F.struct(at.alias("at"), told.alias("t")))))
    one = part.groupBy(*by).agg(F.min_by(F.struct(*radio.columns), at).alias("_row"), notes.alias("_notes"), *first.values())
    fold = F.aggregate("_notes", F.lit(""), lambda a, x: F.when(a == "", x.t).when(F.contains(a, x.t), a).otherwise(F.concat(a, F.lit("\n"), x.t)))

    def value(c: str) -> Column:
        own = F.col(f"_row.{c}")
        return (F.col("_name") if c == "model" else fold if c == "notes" else F.col(f"_f_{c}") if c in filled else own).alias(c)

    return one.select(*map(value, radio.columns))


def dedupe_catalog(radio: DataFrame, fields: Sequence[str] = MERGE_FIELDS, order: str = "id") -> DataFrame:
    """The most complete row of each (brand, model), ties to the lowest id. Where rows go, their notes stay: all notes
    that aren't blank, in rank order, one below the other.

    One aggregate; of the rows of a key only notes are collected, as they all go into the result.
    """
    keys = ["brand", "model"]
    rank = F.struct((-completeness(radio, fields)).alias("less"), order)
    notes = F.sort_array(F.collect_list(F.when(text(F.col("notes")) != "", F.struct(rank.alias("at"), F.col("notes").alias("t")))))
    one = radio.groupBy(*keys).agg(F.count("*").alias("_rows"), F.min_by(F.struct(*radio.columns), rank).alias("_row"), notes.alias("_notes"))
    lines = F.array_join(F.transform("_notes", lambda x: x.t), "\n")
    kept = F.when(F.col("_rows") > 1, lines).otherwise(F.col("_row.notes"))
    return one.select(*(kept.alias(c) if c == "notes" else F.col(f"_row.{c}") for c in radio.columns))


def rename_brands(df: DataFrame, mapping: DataFrame, column: str = "brand") -> DataFrame:
    """``df`` with exact names of ``mapping`` (old, new) replaced, and ``renamed``."""
    one = mapping.groupBy("old").agg(F.max("new").alias("_new"))
    out = df.join(one, F.col(column) == F.col("old"), "left").withColumn("renamed", F.col("_new").isNotNull())
    return out.withColumn(column, F.coalesce("_new", column)).drop("old", "_new")


def merge_selected(radio: DataFrame, groups: DataFrame, picks: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``radio`` after merges of the ``groups`` (group_id, id): of each only the survivor stays, its first row by (brand, model,
    id), where ``picks`` (group_id, field, id) name the row that supplies a field; other fields are the survivor's own.
    Rows in no group stay as they are.
    """
    rows = groups.join(radio, "id")
    first = F.min_by(F.struct(*radio.columns), F.struct("brand", "model", "id"))
    survivor = rows.groupBy("group_id").agg(first.alias("_row")).select("group_id", "_row.*")
    long = rows.select("group_id", "id", *(F.col(c).cast("string").alias(c) for c in fields)).unpivot(["group_id", "id"], list(fields), "field", "value")
    of = lambda c: F.max(F.when(F.col("field") == c, F.struct(F.col("value").alias("v")))).alias(f"_p_{c}")
    picked = picks.join(long, ["group_id", "id", "field"]).groupBy("group_id").agg(*map(of, fields))
    kinds = dict(radio.dtypes)
    chosen = {c: F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.v").cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in fields}
    merged = survivor.join(picked, "group_id", "left").select(*(chosen.get(c, F.col(c)) for c in radio.columns))
    return radio.join(groups.select("id").distinct(), "id", "left_anti").select(*radio.columns).unionByName(merged)


def delete_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("id").distinct(), "id", "left_anti")


def best_rows(radio: DataFrame, fields: Sequence[str]) -> DataFrame:
    return most_complete(radio, ["brand", "model"], fields, "id")
