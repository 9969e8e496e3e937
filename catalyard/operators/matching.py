"""Matching catalogues: anti joins, code and registry lookups, first-wins merges, reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.codes import coded
from ..functions.text import blank, make_id, normalize_model, strip_code_prefix, strip_ws, text, title_case


def keyed(df: DataFrame, brand: str = "brand", model: str = "model") -> DataFrame:
    """``df`` with the comparison key (_b, _m), without rows that have a blank part."""
    out = df.withColumn("_b", title_case(F.col(brand))).withColumn("_m", normalize_model(F.col(model)))
    return out.where("_b <> '' and _m <> ''")


def drop_blank_keys(df: DataFrame, *keys: str) -> DataFrame:
    for k in keys:
        df = df.where(strip_ws(F.col(k)) != "")
    return df


def new_models(products: DataFrame, master: DataFrame) -> DataFrame:
    """Rows of ``products`` whose key isn't in ``master``; repeated products stay."""
    return keyed(products).join(keyed(master).select("_b", "_m").distinct(), ["_b", "_m"], "left_anti").drop("_b", "_m")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """The first (or last) row of each key in ``order``, nulls first. An aggregate: rows are combined before the shuffle, so
    a key that most rows have is no task's load."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*(F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns))


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_wins(df, keys, [F.col(c) for c in order], last=True)


def completeness(df: DataFrame, fields: Sequence[str]) -> Column:
    """How many of ``fields`` aren't blank."""
    return sum(((~blank(df, c)).cast("int") for c in fields), F.lit(0))


def most_complete(df: DataFrame, keys: Sequence[str], fields: Sequence[str], tie: str) -> DataFrame:
    """The row of each key with the most non-blank ``fields``; ties go to the lowest ``tie``."""
    return first_wins(df, keys, [-completeness(df, fields), F.col(tie)])


def union_catalogs(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are empty. The place of the frame is ``source_no``."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("source_no", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    kinds = dict(out.dtypes)
    return out.select(*(text(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in out.columns))


def _both(master: DataFrame, additions: DataFrame) -> DataFrame:
    both = union_catalogs(master, additions)
    return both.withColumn("_b", title_case(F.col("brand"))).withColumn("_m", normalize_model(F.col("model")))


def merge_catalogs(master: DataFrame, additions: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """First row of each (title-case brand, upper-case model); the master goes before the additions."""
    out = first_wins(_both(master, additions), ["_b", "_m"], [F.col("source_no"), F.col(ordinal)])
    return out.withColumn("brand", F.col("_b")).drop("_b", "_m")


def merge_counted(master: DataFrame, additions: DataFrame, ordinal: str = "ordinal") -> tuple[DataFrame, Observation]:
    """``merge_catalogs``, and what tells ``rows``, ``kept`` and ``removed`` once the frame has been written: nothing is read for it."""
    both, order, seen = _both(master, additions), [F.col("source_no"), F.col(ordinal)], Observation()
    rest = [c for c in both.columns if c not in ("_b", "_m")]
    pick = F.min_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))))
    one = both.groupBy("_b", "_m").agg(pick.alias("_row"), F.count("*").alias("_times"))
    rows = F.coalesce(F.sum("_times"), F.lit(0))
    one = one.observe(seen, rows.alias("rows"), F.count("*").alias("kept"), (rows - F.count("*")).alias("removed"))
    return one.select(*(F.col("_b").alias(c) if c == "brand" else F.col(f"_row.{c}") for c in rest)), seen


def merge_counts(master: DataFrame, additions: DataFrame) -> DataFrame:
    """rows, kept and removed of ``merge_catalogs``."""
    n = _both(master, additions).groupBy("_b", "_m").agg(F.count("*").alias("n"))
    rows, kept = F.coalesce(F.sum("n"), F.lit(0)).cast("long"), F.count("*")
    return n.agg(rows.alias("rows"), kept.alias("kept"), (rows - kept).alias("removed"))


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """(brand, model, side) of the keys that only one of two catalogues has."""
    ka, kb = (keyed(x).select(F.col("_b").alias("brand"), F.col("_m").alias("model")).distinct() for x in (a, b))
    return ka.exceptAll(kb).withColumn("side", F.lit("first")).union(kb.exceptAll(ka).withColumn("side", F.lit("second")))


def key_digests(keys: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, and four sums of hashes) of the rows of ``keys``: equal for equal rows in any order. Rows combine before the
    shuffle, which carries at most ``buckets`` rows a task."""
    cols = [F.col(c) for c in keys.columns]
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)
    lanes = [F.sum(F.pmod(F.shiftright(h, by), F.lit(1 << 32))).alias(f"lane_{i}") for i, (h, by) in enumerate([(one, 0), (one, 32), (two, 0), (two, 32)])]
    return keys.groupBy(F.pmod(one, F.lit(buckets)).alias("bucket")).agg(F.count("*").alias("n"), *lanes)


def differing_buckets(a: DataFrame, b: DataFrame, buckets: int) -> DataFrame:
    """(bucket) of the buckets of keys that two catalogues don't have the same rows of."""
    da, db = key_digests(a, buckets), key_digests(b, buckets)
    lanes = [c for c in da.columns if c != "bucket"]
    db = db.withColumnsRenamed({c: f"{c}_b" for c in lanes})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in lanes]
    joined = da.join(db, "bucket", "full_outer")
    return joined.where(~reduce(lambda x, y: x & y, same)).select("bucket")


def reconcile_by_digest(a: DataFrame, b: DataFrame, buckets: int = 1 << 14) -> DataFrame:
    """As ``reconcile``, for catalogues that are mostly alike: both are summed up in ``buckets`` of keys, and only rows of buckets
    that differ are compared. Repeated rows can make a bucket differ, which then turns out to have the same keys.

    Equal catalogues shuffle digests alone. Both are read twice. Two differing buckets look alike with a chance of 2^-128.
    """
    ka, kb = (keyed(x).select(F.col("_b").alias("brand"), F.col("_m").alias("model")) for x in (a, b))
    differ = differing_buckets(ka, kb, buckets)
    bucket = F.pmod(F.xxhash64("brand", "model"), F.lit(buckets))
    # at most ``buckets`` numbers
    ka, kb = (k.join(F.broadcast(differ), bucket == F.col("bucket"), "left_semi").distinct() for k in (ka, kb))
    return ka.exceptAll(kb).withColumn("side", F.lit("first")).union(kb.exceptAll(ka).withColumn("side", F.lit("second")))


def attach_code(models: DataFrame, codes: DataFrame) -> DataFrame:
    """``models`` with code and generated id; both empty where the brand has no code."""
    return coded(models, codes).withColumn("fcc_id", text(make_id(F.col("code"), F.col("model"))))


def flag_exists(models: DataFrame, registry: DataFrame, codes: DataFrame) -> DataFrame:
    """``exists``: Yes or No by the ``registry`` (fcc_id); empty where no id was generated.

    Generated ids have a hyphen after the code, registry ids often none: both are compared as (code, product), the
    registry's being split by the longest of ``codes`` (code). models: code, fcc_id.
    """
    found = resolve_grantee(registry.select("fcc_id").distinct(), codes).where("grantee_code is not null")
    known = found.select(F.col("grantee_code").alias("_c"), F.col("product").alias("_p"), F.lit(True).alias("_known")).distinct()
    product = strip_code_prefix(F.col("fcc_id"), F.col("code"))
    joined = models.withColumn("_product", product).join(known, (F.col("code") == F.col("_c")) & (F.col("_product") == F.col("_p")), "left")
    flag = F.when(text(F.col("fcc_id")) == "", "").when(F.col("_known"), "Yes").otherwise("No")
    return joined.withColumn("exists", flag).drop("_known", "_c", "_p", "_product")


def resolve_grantee(ids: DataFrame, codes: DataFrame) -> DataFrame:
    """``ids`` (fcc_id) with the longest code that it begins with (null if none) and the product that follows.

    One equality lookup for each distinct length of a code; the lengths are few, the codes may be many.
    """
    one = codes.select("code").where("code <> ''").distinct()
    lengths = sorted(r.n for r in one.select(F.length("code").alias("n")).distinct().collect())
    out = ids
    for n in lengths:
        of_length = one.where(F.length("code") == n).select(F.col("code").alias(f"_c{n}"))
        out = out.join(of_length, F.substr("fcc_id", F.lit(1), F.lit(n)) == F.col(f"_c{n}"), "left")
    code = F.coalesce(*(F.col(f"_c{n}") for n in reversed(lengths)), F.lit(None).cast("string"))
    rest = F.substr("fcc_id", F.length("grantee_code") + 1)
    product = F.when(F.col("grantee_code").isNull(), F.col("fcc_id")).otherwise(strip_ws(F.regexp_replace(rest, "^-+", "")))
    return out.withColumn("grantee_code", code).withColumn("product", product).drop(*(f"_c{n}" for n in lengths))


def grantee_name(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (code) with the grantee's name, or the code itself where ``names`` (code, name) lacks it."""
    hit = names.select("code", F.col("name").alias("_name"), F.lit(True).alias("_hit"))
    return rows.join(hit, "code", "left").withColumn("name", F.when(F.col("_hit"), F.col("_name")).otherwise(F.col("code"))).drop("_name", "_hit")


def missing_brands(radio: DataFrame, brand: DataFrame) -> DataFrame:
    """``brand`` (name, code) with the brands that only ``radio`` (brand) has, without a code."""
    new = radio.select(F.col("brand").alias("name")).where("name <> ''").distinct().join(brand, "name", "left_anti")
    return brand.unionByName(new.withColumn("code", F.lit(None).cast("string")))
