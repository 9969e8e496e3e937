"""Hard-negative mining by vertical scans (BOND) over columnar blocks of integer vectors.

A block holds its vectors dimension by dimension, with each dimension's least and greatest value. An anchor reads dimensions
by its own falling magnitude. What the unread ones can add at least and at most bounds every candidate's score, and candidates
that can't matter leave the bitmap: for positives those under the k-th best certain score, for negatives those that fall into
no window, or under the k-th best that is certainly inside. What is left after the last dimension has its exact score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from .common import bounded_batches, bucket_of, discard, stored, table

#: Most rows of a block, and most components; most anchors of a block; dimensions read between two looks at the bounds.
ROWS, CELLS, ANCHORS, STRIDE = 8192, 1 << 21, 512, 16
#: Components are held to this, so that scores of up to 512 dimensions are exact.
MOST = 1 << 27
PARTS = ["n", "dims", "ids", "labels", "vectors"]
BLOCK = "key string, n int, dims int, ids binary, labels binary, vectors binary"


def _pack(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs (id, label, vector) into blocks of at most ``rows`` rows with keys of their own, vectors dimension by dimension;
    shorter vectors end in zeros."""

    def block(ids: np.ndarray, labels: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        parts = [uuid4().hex, len(ids), m.shape[1], ids.tobytes(), labels.tobytes(), np.ascontiguousarray(m.T).tobytes()]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(parts, kinds)], ["key", *PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = cells = 0
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            flat, upto = lists.flatten().to_numpy(), lists.offsets.to_numpy()
            size = np.diff(upto)
            m = np.zeros((len(size), int(size.max())), dtype="<i4")
            m[np.arange(m.shape[1]) < size[:, None]] = flat
            ids, labels = b.column(0).to_numpy(), b.column(1).to_numpy()
            some = max(1, min(rows, CELLS // max(m.shape[1], 1)))
            for a in range(0, len(ids), some):
                part = ids[a : a + some], labels[a : a + some], m[a : a + some]
                if held and (count + len(part[0]) > rows or cells + part[2].size > CELLS):
                    yield block(*_joined(held))
                    held, count, cells = [], 0, 0
                held.append(part)
                count, cells = count + len(part[0]), cells + part[2].size
        if held:
            yield block(*_joined(held))

    return run


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = max(p[2].shape[1] for p in parts)
    m = [np.pad(p[2], ((0, 0), (0, wide - p[2].shape[1]))) for p in parts]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(m)


class Block:
    """Vectors by dimension, with the least and greatest value of each. ``exact``: float products of any scores stay exact."""

    def __init__(self, n: int, dims: int, ids: bytes, labels: bytes, vectors: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        whole = np.frombuffer(vectors, "<i4").reshape(dims, n)
        self.least, self.greatest = (f(axis=1).astype(np.int64) if n else np.zeros(dims, np.int64) for f in (whole.min, whole.max))
        self.size = np.maximum(np.abs(self.least), np.abs(self.greatest))
        self.columns = whole

    def of_type(self, kind: type) -> np.ndarray:
        if self.columns.dtype != kind:
            self.columns = self.columns.astype(kind)
        return self.columns


def scan(q: np.ndarray, block: Block, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The places in ``block`` that are left of ``alive``, and their exact scores with ``q``. ``keep`` gets the least and the
    greatest score that each may still have, and says which stay. ``read``: components read are added to its first item."""
    d = min(len(q), len(block.least))
    q = q[:d]
    kind = np.float64 if int((np.abs(q) * block.size[:d]).sum()) < 1 << 53 else np.int64
    columns = block.of_type(kind)
    order = np.argsort(-np.abs(q), kind="stable")
    ends = np.sort(np.stack([q * block.least[:d], q * block.greatest[:d]]), axis=0)[:, order]
    rest = np.c_[ends[:, ::-1].cumsum(axis=1)[:, ::-1], [0, 0]]  # what dimensions from each place on add, at least and at most
    score = np.zeros(len(alive), dtype=kind)
    for at in [*range(0, d, STRIDE), d] if d else [0]:
        mask = keep(score + rest[0, at], score + rest[1, at])
        if not mask.all():
            alive, score = alive[mask], score[mask]
        dims = order[at : at + STRIDE]
        if not len(alive) or not len(dims):
            break
        some = columns[dims] if 2 * len(alive) > columns.shape[1] else columns[np.ix_(dims, alive)]
        if some.shape[1] != len(alive):
            some = some[:, alive]
        score = score + q[dims].astype(kind) @ some
        if read is not None:
            read[0] += len(dims) * len(alive)
    return alive, score.astype(np.int64)


def _kth(values: np.ndarray, k: int) -> float | int:
    return np.partition(values, len(values) - k)[len(values) - k]


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by falling score, ties by smaller id."""
    at = np.lexsort((ids, -scores))[:k]
    return ids[at], scores[at]


_NONE = np.empty(0, np.int64), np.empty(0, np.int64)


def best_alike(q: np.ndarray, own: int, label: int, block: Block, k: int, found: tuple = _NONE, read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``k`` best rows of ``label`` other than id ``own``, of ``block`` and those ``found`` before."""
    floor = [found[1][-1] if len(found[1]) == k else None]

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(low) >= k and (floor[0] is None or (low > floor[0]).any()):
            sure = _kth(low, k)
            floor[0] = sure if floor[0] is None else max(floor[0], sure)
        return high >= floor[0] if floor[0] is not None else np.ones(len(high), dtype=bool)

    alive, scores = scan(q, block, np.flatnonzero((block.labels == label) & (block.ids != own)), keep, read)
    return _first(np.r_[found[0], block.ids[alive]], np.r_[found[1], scores], k)


def best_within(q: np.ndarray, own: int, label: int, windows: list[tuple[int, int]], block: Block, k: int, found: list[tuple], read: list | None = None) -> list[tuple]:
    """For each window (least, greatest score) ids and scores of the ``k`` best rows of other labels inside, as ``best_alike``."""
    floors = [max(a, f[1][-1]) if len(f[1]) == k else a for (a, _), f in zip(windows, found)]
    open_ = [i for i, (a, z) in enumerate(windows) if a <= z]
    if not open_:
        return found

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(low), dtype=bool)
        for i in open_:
            top = windows[i][1]
            sure = low[(low > floors[i]) & (high <= top)]
            if len(sure) >= k:
                floors[i] = _kth(sure, k)
            mask |= (high >= floors[i]) & (low <= top)
        return mask

    alive, scores = scan(q, block, np.flatnonzero((block.labels != label) & (block.ids != own)), keep, read)
    ids, out = block.ids[alive], list(found)
    for i in open_:
        inside = (scores >= windows[i][0]) & (scores <= windows[i][1])
        if inside.any():
            out[i] = _first(np.r_[out[i][0], ids[inside]], np.r_[out[i][1], scores[inside]], k)
    return out


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    return stored(rows.select("id", "label", "vector").mapInArrow(_pack(size), BLOCK), name)


def _meet(blocks: DataFrame, anchors: DataFrame, n_anchors: int) -> DataFrame:
    """Every block beside every block of anchors (``a``), dealt by both over as many tasks as shuffles have."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = blocks.withColumn("deal", bucket_of(tasks, "key")).drop("key").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
    right = anchors.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    return left.repartition(tasks, "a", "deal").join(right.repartition(tasks, "a", "deal").hint("merge"), ["a", "deal"])


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each row of ``vectors`` (id, label, vector
    of integers) for which ``anchor`` is true.

    Positives are the anchor's first ``positives`` rows of its label; negatives of each, from rank 1, the first ``negatives``
    rows of other labels whose score is ``low`` to ``high`` per cent of the positive's. Higher inner products come first, ties
    by smaller id. Rows with a null id, label, vector or component take no part, nor do rows of the anchor's own id as its
    partners; a repeated row is a partner, or an anchor, as often as it comes. Shorter vectors end in zeros; components beyond
    ``MOST`` count as that. An empty table, or one without anchors, gives an empty result; other columns are not read.

    Rows lie in blocks of at most ``ROWS`` (of ``CELLS`` components), anchors in blocks of ``ANCHORS``. A task takes the blocks
    of rows that a block of anchors meets there one after another and keeps the best so far: it returns at most so many for
    an anchor, however many rows it has seen. The driver holds no more than counts.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    held = F.transform("vector", lambda x: F.greatest(F.least(x, F.lit(MOST)), F.lit(-MOST)).cast("int"))
    whole = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    rows = vectors.where(whole).select(F.col("id").cast("long"), F.col("label").cast("long"), "vector", anchor.alias("is_anchor"))
    rows = rows.withColumn("vector", held)
    blocks = _blocks(rows, ROWS, "vector-blocks")
    asking = rows.where("is_anchor")
    n = -(-asking.count() // ANCHORS)
    if not n:
        discard(blocks)
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    packed = _blocks(asking.repartition(n, F.xxhash64("id", "label", "vector")), ANCHORS, "anchor-blocks")
    numbered = stored(packed.select("key", (F.row_number().over(Window.orderBy("key")) - 1).alias("a")), "anchor-numbers")
    n = numbered.count()
    anchors = packed.join(numbered, "key").drop("key")
    anchors = stored(anchors.withColumnsRenamed({c: f"q_{c}" for c in PARTS}), "anchors")
    discard(packed)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, asked in groupby(_rows_of(batches), lambda x: x[0]["a"]):
            found: dict[int, tuple] = {}
            for _, block, ask in asked:
                for i, (own, label) in enumerate(zip(ask.ids.tolist(), ask.labels.tolist())):
                    found[i] = best_alike(ask.columns[:, i].astype(np.int64), own, label, block, positives, found.get(i, _NONE))
            yield from _found([(a, i, 0, *x) for i, x in found.items()])

    where = "a int, i int, w int, id long, score long"
    first = F.row_number().over(_window("a", "i"))
    met = _meet(blocks, anchors, n).mapInArrow(alike, where)
    chosen = stored(met.withColumn("w", first).where(F.col("w") <= positives).withColumn("w", F.col("w").cast("int")), "positives")
    spans = chosen.groupBy("a").agg(F.collect_list(F.struct("i", "w", "score")).alias("spans"))  # at most ANCHORS x positives
    spanned = anchors.join(spans, "a")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, asked in groupby(_rows_of(batches), lambda x: x[0]["a"]):
            spans: dict[int, list] = {}
            found: dict[int, list] = {}
            for r, block, ask in asked:
                for x in sorted(r["spans"], key=lambda x: (x["i"], x["w"])) if not spans else ():
                    spans.setdefault(x["i"], []).append((x["w"], -(-low * x["score"] // 100), high * x["score"] // 100))
                for i, of in spans.items():
                    own, label, windows = int(ask.ids[i]), int(ask.labels[i]), [x[1:] for x in of]
                    found[i] = best_within(ask.columns[:, i].astype(np.int64), own, label, windows, block, negatives, found.get(i, [_NONE] * len(of)))
            yield from _found([(a, i, w, *x) for i, f in found.items() for (w, _, _), x in zip(spans[i], f)])

    met = _meet(blocks, spanned, n).mapInArrow(inside, where)
    ranked = met.withColumn("rank", F.row_number().over(_window("a", "i", "w"))).where(F.col("rank") <= negatives)
    ranked = ranked.select("a", "i", "w", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
    ids = anchors.select("a", "q_ids").mapInArrow(_anchor_ids, "a int, i int, anchor_id long")
    out = ranked.join(named, ["a", "i", "w"]).join(ids, ["a", "i"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _window(*by: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(F.desc("score"), "id")


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block, Block]]:
    """Each row, its block, and its block of anchors."""
    last, ask = None, None
    for b in batches:
        for r in b.to_pylist():
            if r["a"] != last:
                last, ask = r["a"], Block(*(r[f"q_{c}"] for c in PARTS))
            yield r, Block(*(r[c] for c in PARTS)), ask


def _found(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """(a, i, w, ids, scores) as rows."""
    some = [x for x in rows if len(x[3])]
    for a in range(0, len(some), 4096):
        part = some[a : a + 4096]
        n = [len(x[3]) for x in part]
        cols = [np.repeat(np.array([x[c] for x in part], dtype=np.int32), n) for c in range(3)]
        cols += [np.concatenate([x[c] for x in part]) for c in (3, 4)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "i", "w", "id", "score"])


def _anchor_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(ids, "<i8")
            cols = [np.full(len(x), a, np.int32), np.arange(len(x), dtype=np.int32), x]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "i", "anchor_id"])


def scaled(embeddings: DataFrame) -> DataFrame:
    """(id, label, vector) of ``embeddings`` (vec_id, label, embedding): components are floor(256 x); where vec_id is divisible
    by 7 the label is (label + 1) % 10. Rows with a null or non-finite component are left out."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embeddings.where(finite).select(F.col("vec_id").alias("id"), label.alias("label"), F.transform(x, lambda v: F.floor(256 * v)).alias("vector"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(scaled(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


ORACLE = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, CAST(list_inner_product(a.v, v.v) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE alike) WHERE k <= 5),
  n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank, s.vec_id AS negative_id,
      p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
