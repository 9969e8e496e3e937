"""Bounded lists, sketches of parts, and counts of the frames that are written."""

import pytest
from pyspark.sql import functions as F

from catalyard.operators import matching, reports, upsert


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def radios(spark):
    odd = spark.createDataFrame([(None, "x"), (None, None), ("lone", None)], "brand string, model string")
    return spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 40)).alias("brand"), F.concat(F.lit("m"), F.col("id") % 977).alias("model")).union(odd).cache()


def test_lists_are_bounded_before_the_shuffle(spark, radios):
    want = {}
    for r in radios.collect():
        want.setdefault(r.brand, []).append(r.model)
    got = {r.brand: (r.n, r.models) for r in reports.first_models(radios, 7).collect()}
    assert got == {b: (len(m), ", ".join(sorted(x for x in m if x is not None)[:7])) for b, m in want.items()}
    shown = plan(reports.first_models(spark.range(10).select((F.col("id") % 2).cast("string").alias("brand"), F.col("id").cast("string").alias("model")), 7))
    assert "WindowGroupLimit" in shown and "Partial" in shown
    whole = {(r.brand, r.place): r.model for r in reports.models_of(radios).collect()}
    assert whole == {(b, k): m for b, all_ in want.items() for k, m in enumerate(sorted(all_, key=lambda m: (m is not None, m)), 1)}
    assert reports.models_of(radios.limit(0)).count() == reports.first_models(radios.limit(0)).count() == 0


def test_sketches_of_parts_add_up(spark):
    df = spark.range(200_000).select((F.col("id") % 13).alias("part"), F.concat(F.lit("brand "), F.col("id") % 50_000).alias("brand"))
    parts, whole = reports.part_sketches(df, "part"), reports.part_sketches(df.withColumn("part", F.lit(0)), "part")
    a, b = reports.totals_of(parts).first(), reports.totals_of(whole).first()
    assert a.n_rows == 200_000 and a.n_brands == b.n_brands and abs(a.n_brands - 50_000) < 1000
    changed = spark.range(10).select(F.lit(3).cast("long").alias("part"), F.lit("one").alias("brand"))
    again = reports.renewed(parts, reports.part_sketches(changed, "part"), "part")
    exact = df.where("part <> 3").union(changed)
    assert reports.totals_of(again).first().n_rows == exact.count() and abs(reports.totals_of(again).first().n_brands - 50_001) < 1000
    counts = reports.renewed(reports.part_counts(df, "part"), reports.part_counts(changed, "part"), "part")
    assert rows(reports.counts_of(counts)) == rows(reports.count_by_brand(exact))
    none = reports.totals_of(reports.part_sketches(df.limit(0), "part")).first()
    assert tuple(none) == (0, 0)


def test_counts_come_with_the_writing(spark, tmp_path):
    t = spark.createDataFrame([("a", "0"), ("b", "0")], "k string, v string")
    batch = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("c", "1", 1)], "k string, v string, at int")
    for k, overwrite in enumerate((True, False)):
        made = upsert.upsert(t, batch, ["k"], ["v"], ["at"], overwrite)
        out, seen = upsert.counted(made, overwrite)
        out.write.parquet(str(tmp_path / f"u{k}"))
        want = upsert.tally(made, overwrite).first().asDict()
        assert seen.get == {c: want[c] for c in ("created", "updated", "skipped", "total")} and "CollectMetrics" in plan(out)
    m = spark.createDataFrame([(1, "icom", "a"), (2, "ICOM", "A "), (3, "K-po", "x")], "ordinal int, brand string, model string")
    merged, seen = matching.merge_counted(m, m.where("ordinal > 1"))
    merged.write.parquet(str(tmp_path / "m"))
    assert rows(spark.read.parquet(str(tmp_path / "m"))) == rows(matching.merge_catalogs(m, m.where("ordinal > 1")))
    assert seen.get == matching.merge_counts(m, m.where("ordinal > 1")).first().asDict()
