"""Tables of merges, prefixes and renames against one after another."""

import random

import pytest
from pyspark.sql import functions as F

from catalyard.operators import maintain, renames


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def radios(spark, rng, brands, n=60):
    keys = rng.sample([(b, f"m{i}") for b in brands for i in range(8)], n)
    some = lambda *x: rng.choice([None, "", "0", *x])
    data = [(i, b, m, some("yes", "no"), rng.choice([None, 0, 5, 7]), some("a", "b", "a\nb", "c", "b\na")) for i, (b, m) in enumerate(keys)]
    return spark.createDataFrame([*data, (900, None, "m1", "x", 1, "n"), (901, "Other", None, "", 2, None)], "id long, brand string, model string, gps string, battery_mah int, notes string")


@pytest.mark.parametrize("seed", range(4))
def test_merges_equal_one_after_another(spark, seed):
    rng = random.Random(seed)
    brands = [f"B{i}" for i in range(8)]
    radio = radios(spark, rng, brands).cache()
    pairs = [tuple(rng.sample([*brands, "New"], 2)) for _ in range(6)]
    want = radio
    for a, b in pairs:
        want = spark.createDataFrame(maintain.merge_brand(want, a, b).collect(), radio.schema)
    got = renames.merge_brands(radio, spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "source string, target string, at int"))
    assert rows(got) == rows(want)


def test_pairs_without_turns_are_ordered(spark):
    pairs = spark.createDataFrame([("b", "c"), ("a", "b"), ("c", "d"), ("x", "d"), ("q", "r")], "source string, target string")
    turn = {r.source: r.at for r in renames.in_order(pairs).collect()}
    assert turn["a"] < turn["b"] < turn["c"] and len(set(turn.values())) == 5
    ways = {r.brand: (r.final, len(r.path)) for r in renames.routes(renames.in_order(pairs)).collect()}
    assert ways == {"a": ("d", 3), "b": ("d", 2), "c": ("d", 1), "x": ("d", 1), "q": ("r", 1)}
    long = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    ways = {r.brand: r.final for r in renames.routes(renames.in_order(spark.createDataFrame(long, "source string, target string"))).collect()}
    assert ways == {f"n{i}": "n40" for i in range(40)}
    for bad, why in [([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")], "lead back"), ([("a", "a")], "lead back"), ([("a", "b"), ("a", "c")], "several targets")]:
        with pytest.raises(ValueError, match=why):
            renames.in_order(spark.createDataFrame(bad, "source string, target string"))
    assert renames.routes(renames.in_order(pairs.limit(0))).count() == 0


def test_prefixes_equal_one_after_another(spark):
    r = spark.createDataFrame([(1, "b", "AB-x", "1", "p"), (2, "b", "ABx", "2", "q"), (3, "b", "x", "", "r"), (4, "c", "ABx", "", ""), (5, "c", "CDx", "z", "n"), (6, "c", "x", "", ""), (7, None, "ABx", "", "")], "id int, brand string, model string, gps string, notes string")
    codes = spark.createDataFrame([("b", "AB"), ("c", "CD"), ("c", "CD"), ("none", "x")], "brand string, code string")
    want = maintain.clean_prefix(maintain.clean_prefix(r, "b", "AB"), "c", "CD")
    assert rows(renames.clean_prefixes(r, codes)) == rows(want)
    for bad in ([("b", "")], [(None, "x")], [("b", "A"), ("b", "B")]):
        with pytest.raises(ValueError):
            renames.clean_prefixes(r, spark.createDataFrame(bad, "brand string, code string"))


def test_renames_are_counted_as_they_are_written(spark, tmp_path):
    radio = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "a")], "id int, brand string")
    brands = spark.createDataFrame([("a", "1"), ("z", "2")], "name string, code string")
    mapping = spark.createDataFrame([("a", "b"), ("b", "k")], "source string, target string")
    out, names, n, m = renames.rename_in_both(radio, brands, mapping)
    out.write.parquet(str(tmp_path / "r"))
    names.write.parquet(str(tmp_path / "n"))
    assert (n.get["renamed"], m.get["renamed"]) == (3, 1) == tuple(renames.rename_counts(radio, brands, mapping).first())
    assert rows(spark.read.parquet(str(tmp_path / "r"))) == [(1, "k"), (2, "k"), (3, "c"), (4, None), (5, "k")]
    assert rows(spark.read.parquet(str(tmp_path / "n"))) == [("k", "1"), ("z", "2")]
