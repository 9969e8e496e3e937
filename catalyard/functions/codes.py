"""Code tables of the catalogue: makers' registry codes are data, passed in as (brand, code) frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text


def code_status(brands: DataFrame, codes: DataFrame, without: DataFrame) -> DataFrame:
    """``brands`` (brand) with status: known, none expected, or unknown. codes: (brand, code); without: (brand)."""
    known = codes.select("brand", F.lit(True).alias("_known")).distinct()
    none = without.select("brand", F.lit(True).alias("_none")).distinct()
    status: Column = F.when(F.col("_known"), "known").when(F.col("_none"), "none expected").otherwise("unknown")
    return brands.join(known, "brand", "left").join(none, "brand", "left").withColumn("status", status).drop("_known", "_none")


def coded(df: DataFrame, codes: DataFrame) -> DataFrame:
    """``df`` with the code of its exact brand; unmatched: empty."""
    one = codes.groupBy("brand").agg(F.max("code").alias("code"))
    return df.join(one, "brand", "left").withColumn("code", text(F.col("code")))
