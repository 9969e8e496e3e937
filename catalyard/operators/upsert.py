"""Batch upserts and the checks around them: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import bad_year, parse_battery, parse_year, strip_ws, text
from .conflicts import first_claims, renames


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str], order: Sequence[str], overwrite: bool = True) -> DataFrame:
    """``target`` after ``batch``, with ``action`` (created, updated, skipped, kept) and ``times`` (rows of the batch).

    overwrite: the last row of a key in ``order`` sets the ``update`` columns of an existing row or makes a new one.
    Otherwise the first row of a key makes a new row and existing rows stay. ``batch`` has ``target``'s columns and
    those of ``order``.
    """
    rest = [c for c in target.columns if c not in keys]
    pick = (F.max_by if overwrite else F.min_by)(F.struct(F.lit(True).alias("_in"), *rest), F.struct(*order))
    one = batch.groupBy(*keys).agg(pick.alias("_row"), F.count("*").alias("times"))  # combined before the shuffle
    one = one.select(*keys, "times", "_row._in", *(F.col(f"_row.{c}").alias(f"_new_{c}") for c in rest))
    old = target.withColumn("_was", F.lit(True))
    both = old.join(one, list(keys), "full_outer")
    was, inn = F.col("_was").isNotNull(), F.col("_in").isNotNull()

    def value(c: str) -> Column:
        new = ~was | (inn & F.lit(overwrite and c in update))
        return F.when(new, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)

    action = F.when(~was, "created").when(~inn, "kept").otherwise("updated" if overwrite else "skipped")
    return both.select(*keys, *(value(c) for c in target.columns if c not in keys), action.alias("action"), F.coalesce("times", F.lit(0)).cast("long").alias("times"))


def tally(upserted: DataFrame, overwrite: bool = True, errors: DataFrame | None = None) -> DataFrame:
    """created, updated, skipped, errors and total rows; repeats of a key in the batch count as updates or as skips, rows of
    ``errors`` as errors."""
    rows = upserted.select("action", "times")
    if errors is not None:
        rows = rows.union(errors.select(F.lit("error"), F.lit(1).cast("long")))
    zero = F.lit(0).cast("long")
    created, bad = (F.count_if(F.col("action") == a) for a in ("created", "error"))
    total = F.coalesce(F.sum("times"), zero)
    rest = total - created - bad
    updated, skipped = (rest, zero) if overwrite else (zero, rest)
    return rows.agg(created.alias("created"), updated.alias("updated"), skipped.alias("skipped"), bad.alias("errors"), total.alias("total"))


def counted(upserted: DataFrame, overwrite: bool = True) -> tuple[DataFrame, Observation]:
    """``upserted`` itself, and what tells created, updated, skipped and total once it has been written: the counts of ``tally``
    in the same pass."""
    seen = Observation()
    created, total = F.count_if(F.col("action") == "created"), F.coalesce(F.sum("times"), F.lit(0))
    again, none = total - created, F.count_if(F.lit(False))
    updated, skipped = (again, none) if overwrite else (none, again)
    return upserted.observe(seen, created.alias("created"), updated.alias("updated"), skipped.alias("skipped"), total.alias("total")), seen


def stamp_times(upserted: DataFrame, now: Column) -> DataFrame:
    """created_at and updated_at: an insert sets both, an update the second."""
    return upserted.withColumn("created_at", F.when(F.col("action") == "created", now).otherwise(F.col("created_at"))).withColumn(
        "updated_at", F.when(F.col("action").isin("created", "updated"), now).otherwise(F.col("updated_at"))
    )


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n) of the keys without nulls that more than one row has."""
    known = df.dropna(subset=list(keys))
    return known.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def check_row(df: DataFrame, lengths: Mapping[str, int], year: str | None = None) -> DataFrame:
    """``df`` with ``error``: the first over-long column or a bad year, else null."""
    error = F.lit(None).cast("string")
    if year:
        error = F.when(bad_year(F.col(year)), F.lit(f"{year} is no year"))
    for c in reversed(list(lengths)):
        error = F.when(F.length(c) > lengths[c], F.lit(f"{c} is too long")).otherwise(error)
    return df.withColumn("error", error)


#: The catalogue's columns by their names in files, and how long each may be.
RADIO_COLUMNS = {
    "FCC_ID": ("fcc_id", 50), "Freq. Bands (TX)": ("freq_bands_tx", 200), "Power (W)": ("power_watts", 100),
    "Satellite Tracking": ("satellite_tracking", 50), "Harmonic Suppression Status": ("harmonic_suppression", 100),
    "GPS": ("gps", 50), "APRS": ("aprs", 100), "Air Band": ("air_band", 50), "DMR": ("dmr", 50), "Display": ("display", 200),
    "Cost (Approx)": ("cost_approx", 100), "Known Rebadges / Clones": ("rebadges_clones", None), "Website": ("website", 500),
}
RADIO_LENGTHS = {"brand": 100, "model": 200, **{c: n for c, n in RADIO_COLUMNS.values() if n}}
RADIO_FIELDS = ["fcc_id", "intro_year", "battery_mah", *(c for c, _ in RADIO_COLUMNS.values() if c != "fcc_id"), "notes"]


def radio_rows(rows: DataFrame, order: str) -> DataFrame:
    """Rows of a catalogue file (Brand, Model and other headers, all text) as catalogue rows with ``order`` and ``error``.

    Values are stripped, rows without a brand or model left out, absent columns empty; year and battery are numbers or null.
    """
    have = {c: strip_ws(F.col(f"`{c}`")) if c in rows.columns else F.lit("") for c in (*RADIO_COLUMNS, "Brand", "Model", "Intro Year", "Battery (mAh)")}
    out = rows.select(have["Brand"].alias("brand"), have["Model"].alias("model"), *(have[c].alias(n) for c, (n, _) in RADIO_COLUMNS.items()), have["Intro Year"].alias("_year"), have["Battery (mAh)"].alias("_mah"), order)
    out = check_row(out.where("brand <> '' and model <> ''"), RADIO_LENGTHS, "_year")
    numbers = {"intro_year": parse_year(F.col("_year")), "battery_mah": parse_battery(F.col("_mah")), "notes": F.lit("")}
    return out.withColumns(numbers).select("brand", "model", *RADIO_FIELDS, order, "error")


def import_radios(target: DataFrame, rows: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """``target`` (brand, model, RADIO_FIELDS) after a catalogue file, with action and times, and the rows with errors.

    Keys are only stripped. The last row of a key sets all fields; notes are emptied.
    """
    read = radio_rows(rows, order)
    good = read.where("error is null").drop("error")
    table = target.select("brand", "model", *RADIO_FIELDS)
    return upsert(table, good, ["brand", "model"], RADIO_FIELDS, [order]), read.where("error is not null")


BRAND_FIELDS = ["name", "full_name", "website", "country", "notes"]


def import_brands(target: DataFrame, batch: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """``target`` (code, BRAND_FIELDS) after ``batch`` (code, BRAND_FIELDS, order), with action and times, and the rows that
    fail (order, code, name).

    Rows come one after another: each sets all fields of its code or adds it. One whose name another code has at that time
    fails and changes nothing, so no stored row is lost. Rows without a code or name are left out. order: unique whole numbers
    from 0, dense in runs. Stored rows without a code stay, and keep their names.
    """
    b = batch.select(strip_ws(F.col("code")).alias("code"), *(strip_ws(F.col(c)).alias(c) for c in BRAND_FIELDS), order).where("code <> '' and name <> ''")
    verdict = renames(target, b.select(F.col(order).alias("pos"), "code", "name")).select(F.col("pos").alias("_pos"), F.col("status").alias("_status"))
    judged = b.join(verdict, F.col(order) == F.col("_pos")).drop("_pos")
    table = upsert(target.select("code", *BRAND_FIELDS), judged.where("_status = 'ok'").drop("_status"), ["code"], BRAND_FIELDS, [order])
    return table, judged.where("_status = 'error'").select(order, "code", "name")


def import_grantees(target: DataFrame, batch: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """``target`` (code, name) with the new codes of ``batch`` (code, name, order), and action (created, filled, kept), and the
    rows that fail (order, code, name).

    Rows come one after another: one of a new code adds it, one of a code with a blank name fills it, any other changes nothing.
    One that would take another code's name fails: its code stays as it was. Rows without a code or name are left out.
    """
    b = batch.select(strip_ws(F.col("code")).alias("code"), strip_ws(F.col("name")).alias("name"), F.col(order).alias("pos")).where("code <> '' and name <> ''")
    has = text(F.col("name")) != ""
    known = target.where(has & F.col("code").isNotNull()).select("code")
    judged = first_claims(target.where(has).select("name"), known, b)
    new = judged.where("status = 'ok'").select("code", F.col("name").alias("_name"))
    both = target.select("code", F.col("name").alias("_old"), F.lit(True).alias("_was")).join(new, "code", "full_outer")
    action = F.when(F.col("_was").isNull(), "created").when(F.col("_name").isNotNull(), "filled").otherwise("kept")
    table = both.select("code", F.coalesce("_name", "_old").alias("name"), action.alias("action"))
    return table, judged.where("status = 'error'").select(F.col("pos").alias(order), "code", "name")
