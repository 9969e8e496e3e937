"""op12 against brute force."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from catalyard.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives_=5, low=80, high=100):
    """The contract, row by row, over (vec_id, embedding, label)."""
    held = []
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, lab, q in held:
        if i % 100:
            continue
        score = lambda v: sum(a * b for a, b in zip(q, v))
        others = sorted((-score(v), j, m) for j, m, v in held if j != i)
        for s, j, m in [x for x in others if x[2] == lab][:positives]:
            inside = [(t, n) for t, n, m in others if m != lab and -low * s <= -100 * t <= -high * s]
            out += [(i, j, k, n, -s, -t) for k, (t, n) in enumerate(inside[:negatives_], 1)]
    return sorted(out)


def vectors(n, dims=40, seed=3, labels=4):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 0.15, (n, dims)) + 0.1
    m[n // 2 : n // 2 + n // 5] = m[5]  # many equal vectors: ties
    return [(int(i), [float(np.float32(x)) for x in m[i]], int(rng.integers(0, labels))) for i in range(n)]


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("rows, anchors", [(8192, 512), (30, 2)])
def test_mining_matches_brute_force(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(negatives, "ROWS", rows)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    data = vectors(700)
    odd = [(701, None, 1), (702, data[0][1], None), (703, [None, *data[0][1][1:]], 1), (704, [float("nan"), *data[0][1][1:]], 1), (705, [float("inf"), *data[0][1][1:]], 1), (None, data[0][1], 1)]
    odd += [(800, [], 1), (900, data[9][1][:7], 2), (1000, [-x for x in data[4][1]], 3), data[30], (1100, [0.0] * 40, 9), (1101, [3000.0] * 40, 8)]
    df = spark.createDataFrame(data + odd, SCHEMA).repartition(3).withColumn("score", F.lit("clash")).withColumn("a", F.lit("clash"))
    found = got(negatives.hard_negatives(negatives.scaled(df), F.col("id") % 100 == 0))
    assert found == brute(data + odd) and len({r[0] for r in found}) > 5


def test_empty_lone_and_repeated(spark):
    none = spark.createDataFrame([], SCHEMA)
    mine = lambda df, **k: got(negatives.hard_negatives(negatives.scaled(df), F.col("id") % 100 == 0, **k))
    assert mine(none) == [] and mine(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == [] and mine(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)) == []
    # An anchor given twice is mined twice, and is no partner of itself.
    twice = [(100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [0.9, 0.0], 2), (4, [0.5, 0.0], 2)]
    assert mine(spark.createDataFrame(twice, SCHEMA)) == sorted(2 * [(100, 1, 1, 2, 65536, 58880), (100, 1, 2, 3, 65536, 58880)])
    assert mine(spark.createDataFrame(twice[1:], SCHEMA), negatives=1, low=40) == [(100, 1, 1, 2, 65536, 58880)]


def test_the_scan_reads_less_than_all(spark):
    """Bounds shrink the candidates: on vectors of falling magnitudes most components aren't read, and the result is exact."""
    rng = np.random.default_rng(1)
    m = np.rint(rng.normal(0, 200, (5000, 64)) * 0.9 ** np.arange(64)).astype("<i4")
    block = negatives.Block(5000, 64, np.arange(5000).astype("<i8").tobytes(), (np.arange(5000) % 5).astype("<i8").tobytes(), np.ascontiguousarray(m.T).tobytes())
    read, every = [0], 0
    for i in range(0, 5000, 500):
        q = m[i].astype(np.int64)
        ids, scores = negatives.best_alike(q, i, i % 5, block, 5, read=read)
        exact = sorted((-int(m[j].astype(np.int64) @ q), j) for j in range(5000) if j % 5 == i % 5 and j != i)[:5]
        assert [(-s, j) for j, s in zip(ids.tolist(), scores.tolist())] == exact
        every += 64 * 999
    assert read[0] < 0.6 * every


def test_sql_matches(spark, tmp_path):
    """The registered query and its SQL over one table."""
    df = spark.createDataFrame(vectors(450), SCHEMA)
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(f"select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ({negatives.ORACLE})").fetchall()
    assert got(negatives.op12_hard_negatives(spark, str(tmp_path))) == sorted(want) != []
