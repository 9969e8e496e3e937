"""The three flows of jobs: building a catalogue, taking in grants, cleaning up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compose_id
from ..operators.maintain import clean_prefix, dedupe_catalog, merge_brand
from ..operators.matching import attach_code, flag_exists, grantee_name, merge_catalogs, missing_brands, resolve_grantee
from ..operators.reports import dedupe_batch
from ..operators.upsert import upsert


def build_master(master: DataFrame, additions: DataFrame, codes: DataFrame, registry: DataFrame) -> DataFrame:
    """Two catalogues merged, first row of a key first, each with its maker's code, generated id and whether the registry
    (fcc_id) has that id. codes: (brand, code)."""
    merged = attach_code(merge_catalogs(master, additions), codes)
    return flag_exists(merged, registry, codes.select("code").where("code <> ''").distinct())


def grant_batch(grants: DataFrame, names: DataFrame) -> DataFrame:
    """(brand, model, fcc_id) of the distinct products of ``grants`` (fcc_id) whose id begins with a code of ``names`` (code,
    name). Ids are made distinct before they are looked up."""
    ids = resolve_grantee(grants.select("fcc_id").where("fcc_id <> ''").distinct(), names)
    ids = dedupe_batch(ids.where("grantee_code is not null and product <> ''"), ["grantee_code", "product"])
    named = grantee_name(ids.select(F.col("grantee_code").alias("code"), "product"), names)
    return named.select(F.col("name").alias("brand"), F.col("product").alias("model"), compose_id(F.col("code"), F.col("product")).alias("fcc_id"))


def ingest_grants(radio: DataFrame, grants: DataFrame, names: DataFrame, overwrite: bool = True) -> DataFrame:
    """``radio`` (brand, model, fcc_id) after ``grant_batch``, with action and times: ids of known products are set anew
    (``overwrite``) or kept. Of two ids of a product the greater wins, or the smaller if ids are kept."""
    batch = grant_batch(grants, names)
    return upsert(radio.select("brand", "model", "fcc_id"), batch.withColumn("_at", F.col("fcc_id")), ["brand", "model"], ["fcc_id"], ["_at"], overwrite)


def clean_up(radio: DataFrame, brand: str, code: str, into: str) -> DataFrame:
    """``radio`` without the code before models of ``brand``, that brand merged ``into`` another, and repeats removed."""
    cleaned = clean_prefix(radio, brand, code)
    return dedupe_catalog(merge_brand(cleaned, brand, into))


def registry_of(radio: DataFrame, brands: DataFrame) -> DataFrame:
    """``brands`` (name, code) with the makers that only ``radio`` has."""
    return missing_brands(radio, brands)
