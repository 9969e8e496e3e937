"""Round trips through the database that comes with Spark."""

import pytest
from pyspark.sql import functions as F

from catalyard.sources.relational import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return Store(f"jdbc:derby:{tmp_path_factory.mktemp('db')}/store;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})


@pytest.fixture(scope="module")
def catalogue(spark):
    near = F.when(F.col("id") < 900, F.col("id")).otherwise(F.col("id") * 1_000_000)  # keys that lie unevenly
    return spark.range(1000).select(near.alias("id"), F.concat(F.lit("Brand "), F.col("id") % 7).alias("brand"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("m'"), "id")).alias("model"), (F.col("id") % 30).cast("int").alias("intro_year"))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_catalogue_goes_there_and_back_in_several_tasks(spark, store, catalogue):
    store.replace(catalogue.repartition(4), "radio", batch=100)
    back = store.read(spark, "radio", "id", 5)
    assert back.columns == catalogue.columns and rows(back) == rows(catalogue) == rows(store.read(spark, "radio"))
    sizes = [r["count"] for r in back.groupBy(F.spark_partition_id()).count().collect()]
    assert 5 <= len(sizes) <= 8 and max(sizes) <= 200 and sum(sizes) == 1000
    store.replace(catalogue.limit(3), "radio")  # again, over the old one
    assert store.read(spark, "radio", "id", 5).count() == 3


def test_ranges_cover_nulls_and_small_tables(spark, store):
    df = spark.createDataFrame([(None, "a"), (-5, "b"), (7, "c"), (7, "d"), (7, "e"), (2**40, "f")], "id long, t string")
    store.replace(df, "odd")
    assert rows(store.read(spark, "odd", "id", 3)) == rows(df)
    store.replace(df.limit(0), "odd")
    assert store.read(spark, "odd", "id", 3).count() == 0 and store.key_ranges(spark, "odd", "id", 3) == ["1 = 1"]


def test_a_failed_write_leaves_the_old_table(spark, store, catalogue):
    store.replace(catalogue.limit(10), "kept")
    bad = catalogue.withColumn("model", F.when(F.col("id") == 77, F.raise_error(F.lit("stop"))).otherwise(F.col("model")))
    with pytest.raises(Exception, match="stop"):
        store.replace(bad.repartition(3), "kept")
    assert store.read(spark, "kept").count() == 10
    with pytest.raises(Exception, match="(?i)exist"):
        store._run(spark, "drop table kept", "rename table nowhere to kept")  # one transaction
    assert store.read(spark, "kept").count() == 10
    store.replace(catalogue.limit(20), "kept")
    assert store.read(spark, "kept").count() == 20 and not store.exists(spark, "kept_new")


def test_upserts(spark, store):
    store.replace(spark.createDataFrame([("a", "0", 1), ("b", "0", 2)], "k string, v string, n int"), "up")
    batch = spark.createDataFrame([("a", "1", 9, 1), ("a", "2", 9, 2), ("c", "1", 3, 1)], "k string, v string, n int, at int")
    want = [("a", "2", 1), ("b", "0", 2), ("c", "1", 3)]
    assert store.upsert(batch, "up", ["k"], ["v"], ["at"]) == {"created": 1, "updated": 2, "skipped": 0, "total": 3}
    assert rows(store.read(spark, "up")) == want
    assert store.upsert(batch, "up", ["k"], ["v"], ["at"], split="n")["created"] == 0 and rows(store.read(spark, "up", "n", 2)) == want
