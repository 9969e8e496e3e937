"""Catalogues reconciled by digests, searched by trigrams and paged by number."""

import random

import pytest
from pyspark.sql import functions as F

from catalyard.operators import matching, reports
from catalyard.operators.upsert import upsert
from catalyard.sources.paged import PagedTable
from catalyard.sources.search_index import TrigramIndex


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- U2 ----


def test_digests_find_what_differs(spark):
    a = spark.range(3000).select(F.concat(F.lit("b"), F.col("id") % 7).alias("brand"), F.concat(F.lit("m"), "id").alias("model"))
    b = a.where("model <> 'm17'").union(spark.createDataFrame([("b1", "new"), ("B1", "NEW "), ("b9", " "), (None, "x")], "brand string, model string"))
    want = sorted(map(tuple, matching.reconcile(a, b).collect()))
    assert sorted(map(tuple, matching.reconcile_by_digest(a, b, 512).collect())) == want == [("B1", "NEW", "second"), ("B3", "M17", "first")]
    keys = lambda df: matching.keyed(df).select(F.col("_b").alias("brand"), F.col("_m").alias("model"))
    assert 1 <= matching.differing_buckets(keys(a), keys(b), 512).count() <= 2
    # Equal catalogues, in another order and case: no bucket differs. Repeated rows differ in digests, not in keys.
    other = a.orderBy(F.desc("model")).select(F.upper("brand").alias("brand"), "model")
    assert matching.differing_buckets(keys(a), keys(other), 512).count() == 0 and matching.reconcile_by_digest(a, other, 512).count() == 0
    assert matching.differing_buckets(keys(a), keys(a.union(a.limit(1))), 512).count() == 1 and matching.reconcile_by_digest(a, a.union(a.limit(1))).count() == 0
    swapped = spark.createDataFrame([("x", "y"), ("x", "y"), ("p", "q")], "brand string, model string"), spark.createDataFrame([("x", "z"), ("x", "z"), ("p", "q")], "brand string, model string")
    assert matching.reconcile_by_digest(*swapped, 1).count() == 2  # pairs don't cancel out
    assert matching.reconcile_by_digest(a.limit(0), b.limit(0)).count() == 0 and matching.reconcile_by_digest(a, a.limit(0)).count() == 3000


# ---- F2, F4 ----


@pytest.fixture(scope="module")
def radios(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aAbBÉ%_-1 ß") for _ in range(rng.randrange(n)))
    rows = [(i, word(6), word(9) if i % 9 else None, word(12)) for i in range(400)] + [(1000, "Yaesu", "abababab", "xyz"), (1001, "", "", None)]
    return spark.createDataFrame(rows, "id long, brand string, model string, fcc_id string").cache()


def test_index_answers_as_a_scan_does(spark, radios, tmp_path):
    index = TrigramIndex(str(tmp_path / "i"), slots=8)
    index.create(radios)
    rng = random.Random(6)
    texts = [t for r in radios.collect() for t in (r.brand, r.model, r.fcc_id) if t and len(t) > 2]
    queries = [t[a : a + n] for t in rng.sample(texts, 10) for a, n in [(rng.randrange(len(t) - 2), rng.choice([3, 4, 9]))]] + ["aba", "ABABAB", "yaesu", "none", "%_-", "ß1", "a", "", "ESUA"]
    for q in queries:
        assert ids(index.search(spark, [q], radios)) == ids(reports.search(radios, q)), q
    for terms in ("aba yae", "1 aba", "a b", "ba ss", "abab xyz"):
        got = index.search(spark, terms.split(), radios, ["brand", "model"])
        assert ids(got) == ids(reports.admin_search(radios, terms, ["brand", "model"])), terms
    assert ids(index.search(spark, [], radios)) == ids(radios)
    index.create(radios.limit(0))
    assert ids(index.search(spark, ["aba"], radios.limit(0))) == []
    index.add(radios, 1)
    assert ids(index.search(spark, ["aba"], radios)) == ids(reports.search(radios, "aba"))


def test_a_search_reads_postings_only(spark, radios, tmp_path):
    table = str(tmp_path / "catalogue")
    radios.write.parquet(table)
    stored = spark.read.parquet(table)
    index = TrigramIndex(str(tmp_path / "i"), slots=8)
    index.create(stored)
    read = plan(index.search(spark, ["yaesu"], stored))
    assert "catalogue" not in read and "PushedFilters: [In(gram" in read and "PartitionFilters: [slot" in read


def test_index_follows_upserts(spark, radios, tmp_path):
    index = TrigramIndex(str(tmp_path / "i"), slots=8)
    index.create(radios)
    batch = spark.createDataFrame([(1000, "Icom", "ababab", "zzz", 1), (5, "Yaesu", "new", "", 1), (2000, "Late", "abab", "", 1)], "id long, brand string, model string, fcc_id string, at int")
    now = upsert(radios, batch, ["id"], ["brand", "model", "fcc_id"], ["at"])
    changed = now.where("action in ('created', 'updated')").select(*radios.columns)
    now = now.select(*radios.columns).cache()
    index.add(changed, 1)
    for q in ("yaesu", "icom", "xyz", "abab", "late", "a"):
        assert ids(index.search(spark, [q], now)) == ids(reports.search(now, q)), q
    index.add(changed, 1)  # the same batch again
    again = now.withColumn("brand", F.when(F.col("id") == 1000, "Yaesu").otherwise(F.col("brand"))).cache()
    index.add(again.where("id = 1000"), 2)
    for q in ("yaesu", "icom", "abab"):
        assert ids(index.search(spark, [q], again)) == ids(reports.search(again, q)), q


# ---- T1, A1, A2, T3 ----


def test_pages_by_number(spark, radios, tmp_path):
    table = PagedTable(str(tmp_path / "p"))
    table.create(radios, 7)
    rows = [r.id for r in radios.orderBy("brand", "model", "id").collect()]
    assert table.pages(spark, 50) == 9 and table.pages(spark, 402) == 1
    for number, size in [(1, 50), (4, 50), (9, 50), (10, 50), (3, 130), (1, 1000), (402, 1), (77, 5)]:
        got = [r.id for r in table.page(spark, number, size).collect()]
        assert got == rows[(number - 1) * size : number * size], (number, size)
        assert got == [r.id for r in reports.page(radios, number, size).collect()]
    read = plan(table.page(spark, 4, 50))
    assert "rangepartitioning" not in read and "PartitionFilters: [part" in read and "PushedFilters: [Or(" in read or "PushedFilters: [And" in read
    r = radios.where("id = 1000").first()
    assert table.find_page(spark, (r.brand, r.model, r.id)) == rows.index(1000) // 50 + 1
    with pytest.raises(ValueError, match="numbered from 1"):
        table.page(spark, 0)
    assert table.find_page(spark, (None, None, 0)) == 1 and table.find_page(spark, ("\U0010ffff", "", 0)) == len(rows) // 50 + 1
    none = PagedTable(str(tmp_path / "e"))
    none.create(radios.limit(0), 3)
    assert none.page(spark, 1).count() == none.pages(spark) == 0


def test_lists_come_in_order(spark, radios):
    known = radios.na.fill("")
    low = lambda t: (t or "").lower()
    rows = known.collect()
    got = [(low(r.brand), (r.model or "").upper()) for r in reports.sort_catalog(known).collect()]
    assert got == sorted((low(r.brand), (r.model or "").upper()) for r in rows)
    counts = reports.count_by_brand(known).collect()
    assert [r.brand for r in counts] == sorted({r.brand for r in rows}, key=lambda t: t.encode())
    first = {}
    for r in rows:
        first.setdefault(r.brand, [0, r.id])
        first[r.brand][0] += 1
        first[r.brand][1] = min(first[r.brand][1], r.id)
    got = [(r.brand, r.n) for r in reports.count_by_brand_desc(known, "id").collect()]
    assert got == [(b, n) for b, (n, at) in sorted(first.items(), key=lambda x: (-x[1][0], x[1][1]))]
