"""SimHash near-duplicates: fingerprints, and links found by BK-trees over shards that share a band of bits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, discard, documents, forget_words, sent_if_small, stored, table
from .components import components

BITS = 64
#: A band's tree that would hold more fingerprints is split into shards; each fingerprint asks all of them.
SHARD = 8192
#: Fingerprints of a large band that all others are first compared with; rows that a task holds at a time.
BAND_PIVOTS, HELD = 16, 200_000


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``words`` words, repeats included; fewer words: of the whole sequence."""
    w = text.lower().split()
    if not w:
        return np.empty(0, dtype=">u8")
    joined = b" ".join(w)
    if len(w) <= words:
        return np.frombuffer(xxhash.xxh64_digest(joined, 42), dtype=">u8")
    ends = list(accumulate(map(len, w), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :])]), dtype=">u8")


def simhash(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is 1 in over half the hashes; no hashes: 0. The result is a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view("u1").reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp long) of each row of ``docs``; a null text is empty and has the fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [simhash(shingle_hashes(t, words)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    d = documents(docs)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, fp long")


def band_masks(n: int, radius: int) -> list[int]:
    """Masks such that two fingerprints within ``radius`` agree on one mask's bits at least.

    The bits are cut into radius + j blocks; any j blocks form a mask. j is the least for which chance alone puts few
    fingerprints (of n) into a band, so that the work follows n.
    """
    for j in range(1, 5):
        blocks = radius + j
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        if n / 2 ** (BITS * j // blocks) <= 64:
            break
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, j)]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees over integers, one for each group, held in arrays; children are keyed by distance to their parent."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        """``values``: rows of 64-bit words. ``groups`` (0, 1, ...) must be sorted; a group's first member is its root."""
        n, self.span = len(values), BITS * values.shape[1] + 1
        self.values, self.parent, self.edge = values, np.full(n, -1), np.zeros(n, dtype=np.int64)
        first = np.r_[True, groups[1:] != groups[:-1]] if n else np.zeros(0, dtype=bool)
        self.roots = np.flatnonzero(first)
        rest = np.flatnonzero(~first)
        at = self.roots[groups[rest]]
        while len(rest):  # each turn gives every pending value to a child of the node it stands at
            key = at * self.span + _distance(values[rest], values[at])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]]
            child = rest[new]
            self.parent[child], self.edge[child] = key[new] // self.span, key[new] % self.span
            at = np.repeat(child, np.diff(np.r_[np.flatnonzero(new), len(rest)]))
            rest, at = rest[~new], at[~new]
        inner = np.flatnonzero(self.parent >= 0)
        keys = self.parent[inner] * self.span + self.edge[inner]
        order = np.argsort(keys)
        self.children, self.keys = inner[order], keys[order]

    def near(self, queries: np.ndarray, roots: np.ndarray, radius: int, wide: int = 65536) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, node) within ``radius``, following only edges that triangle inequality leaves.

        At most ``wide`` nodes are looked at in a turn; what more a turn leads to waits."""
        waiting = [(np.arange(len(queries)), roots)]
        while waiting:
            who, node = waiting.pop()
            if len(who) > wide:
                waiting += [(who[wide:], node[wide:]), (who[:wide], node[:wide])]
                continue
            d = _distance(queries[who], self.values[node])
            hit = d <= radius
            if hit.any():
                yield who[hit], node[hit]
            base = node * self.span
            a = np.searchsorted(self.keys, base + np.maximum(d - radius, 0))
            b = np.searchsorted(self.keys, base + np.minimum(d + radius, self.span - 1), "right")
            n = b - a
            if n.any():
                waiting.append((np.repeat(who, n), self.children[np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]))


def _spanning(a: np.ndarray, b: np.ndarray, label: np.ndarray) -> None:
    """Joins a[i] with b[i] in ``label``, where every element points towards the smallest of its class."""
    while True:
        for _ in range(64):
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))


def _links(group: np.ndarray, value: np.ndarray, own: np.ndarray, radius: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that connect what lies within ``radius`` in each group, one pair less than its members at most.

    Sorted by group, then by own, descending (1: the value stands in the group's tree; all of a group ask it).
    """
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    number = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
    tree_at = np.flatnonzero(own == 1)
    forest = Forest(value[tree_at], number[tree_at])
    root_of = np.full(len(start), -1)
    root_of[number[tree_at][forest.roots]] = forest.roots
    label = np.arange(len(value))
    # What is near its root is one class from the start; within it no pair of the tree needs a look, so of the tree only the
    # others ask. Guests (own: 0) stand in no tree here, so nobody finds them: they ask always.
    root = root_of[number]
    asks = np.flatnonzero((root >= 0) & (tree_at[root] != label))
    near = _distance(value[asks], value[tree_at[root[asks]]]) <= radius
    label[asks[near]] = tree_at[root[asks[near]]]
    asks = asks[~(near & (own[asks] == 1))]
    for i in range(0, len(asks), block):
        q = asks[i : i + block]
        for who, node in forest.near(value[q], root[q], radius):
            a, b = q[who], tree_at[node]
            keep = label[a] != label[b]
            if keep.any():
                _spanning(a[keep], b[keep], label)
    while (label[label] != label).any():
        label = label[label]
    linked = np.flatnonzero(label != np.arange(len(label)))
    return linked, label[linked]


def _core(band: pd.DataFrame) -> pd.DataFrame:
    """The largest class of a band's pivots: rows tie u to v, and say how many u has."""
    label: dict[int, int] = {}
    top = lambda x: x if label.setdefault(x, x) == x else top(label[x])
    for u, v in zip(band["u"].tolist(), band["v"].tolist()):
        a, b = top(u), top(v)
        label[max(a, b)] = min(a, b)
    size: dict[int, int] = {}
    for u, n in zip(band["u"].tolist(), band["n"].tolist()):
        size[top(u)] = size.get(top(u), 0) + n
    best = min(size, key=lambda c: (-size[c], c))
    return pd.DataFrame({"i": [band["i"].iloc[0]], "key": [band["key"].iloc[0]], "core": [[x for x in list(label) if top(x) == best]]})


def link_fingerprints(fps: DataFrame, radius: int, shard: int = SHARD) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct ``fps`` (fp long) within ``radius`` bits.

    Every mask of ``band_masks`` gives each fingerprint a band; two within the radius share one, so nothing is lost.
    A band is a BK-tree. One with over ``shard`` fingerprints is cut: those within the radius of one of its BAND_PIVOTS are linked to
    that, pivots that share one to each other, and of the largest class of these, the core, no two need a look at each other.
    The rest are cut into blocks of queries, all into shard trees of about ``shard``, and each tree meets each block. What is cut grows with the rest's square, not the band's; a task reads its
    groups, of a tree and a block of about ``shard`` rows each, one after another, holding ``HELD`` rows or a group more.
    A task returns a spanning forest of what it links, never all pairs.
    """
    spark = fps.sparkSession
    n_fps = fps.count()
    masks = band_masks(n_fps, radius)
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    bands = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    banded = fps.select("fp", F.explode(bands).alias("band")).select("fp", "band.i", "band.key")
    large = banded.groupBy("i", "key").count().where(F.col("count") > shard)
    large = stored(large.select("i", "key", F.ceil(F.col("count") / shard).cast("int").alias("n")), "large-bands")
    whole, cuts, found, rows = banded, [], None, n_fps * len(masks)
    if not large.isEmpty():  # at most a row for each ``shard`` rows of ``banded``
        split = banded.join(large, ["i", "key"])
        whole = banded.join(large.select("i", "key"), ["i", "key"], "left_anti")
        order = F.row_number().over(Window.partitionBy("i", "key").orderBy(F.xxhash64("fp"), "fp"))
        chosen = split.withColumn("k", order).where(F.col("k") <= BAND_PIVOTS).groupBy("i", "key").agg(F.array_sort(F.collect_list("fp")).alias("pivots"))
        near = F.filter("pivots", lambda p: F.bit_count(p.bitwiseXOR(F.col("fp"))) <= radius)
        split = stored(split.join(chosen, ["i", "key"]).select("fp", "i", "key", "n", near.alias("near")), "cut-bands")
        first = F.get("near", F.lit(0))
        tied = split.where("size(near) > 1").select("i", "key", first.alias("u"), F.explode(F.slice("near", 2, BAND_PIVOTS)).alias("v")).distinct()
        weight = split.where("size(near) > 0").groupBy("i", "key", first.alias("u")).agg(F.count("*").alias("n"))
        about = weight.withColumn("v", F.col("u")).unionByName(tied.withColumn("n", F.lit(0).cast("long")))  # a band has at most BAND_PIVOTS squared rows here
        core = about.groupBy("i", "key").applyInPandas(_core, "i int, key long, core array<long>")
        found = split.where("size(near) > 0").select(F.col("fp").alias("u"), first.alias("v")).where("u <> v").union(tied.select("u", "v"))
        inside = F.size(F.array_intersect("near", "core")) > 0
        split = stored(split.join(core, ["i", "key"]).select("fp", "i", "key", "n", (~inside).alias("asks")), "asking")
        rest = split.where("asks").groupBy("i", "key").agg(F.ceil(F.count("*") / shard).cast("int").alias("turns"))
        split = split.join(rest, ["i", "key"])  # bands without a rest are done
        tree, turn = (F.pmod(F.xxhash64("fp", F.lit(k)), F.col(n)).cast("int") for k, n in ((1, "n"), (2, "turns")))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # All stand in a tree, which goes to all blocks of the rest; the rest ask in every tree.
        cuts = [
            split.select("fp", "i", "key", tree.alias("tree"), every("turns").alias("turn"), F.lit(1).alias("own")),
            split.where("asks").select("fp", "i", "key", every("n").alias("tree"), turn.alias("turn"), F.lit(0).alias("own")),
        ]
        rows += split.agg(F.sum(F.col("turns") + F.when(F.col("asks"), F.col("n")).otherwise(0))).first()[0] or 0
    whole = whole.select("fp", "i", "key", F.lit(0).alias("tree"), F.lit(0).alias("turn"), F.lit(1).alias("own"))
    banded = reduce(DataFrame.union, cuts, whole)

    def linked(t: pa.Table) -> pa.RecordBatch:
        fp, i, key, tree, turn, own = (t.column(c).to_numpy() for c in ("fp", "i", "key", "tree", "turn", "own"))
        order = np.lexsort((fp, -own, turn, tree, key, i))
        fp, i, key, tree, turn, own = (x[order] for x in (fp, i, key, tree, turn, own))
        change = (np.diff(i) != 0) | (np.diff(key) != 0) | (np.diff(tree) != 0) | (np.diff(turn) != 0)
        group = np.r_[0, np.cumsum(change)]
        u, v = _links(group, fp.view(np.uint64)[:, None], own, radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            if sum(x.num_rows for x in held) >= HELD:  # whole groups go; the last may go on in this batch
                t = pa.Table.from_batches(held)
                ids = [t.column(c).to_numpy() for c in ("i", "key", "tree", "turn")]
                last = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in ids]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield linked(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
            held.append(b)
        if held:
            yield linked(pa.Table.from_batches(held))

    groups = ["i", "key", "tree", "turn"]
    parts = max(math.ceil(rows / 500_000), int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = banded.repartition(parts, *groups).sortWithinPartitions(*groups).mapInArrow(run, "u long, v long")
    return (links if found is None else links.union(found)).distinct()


def near_duplicates(docs: DataFrame, words: int, radius: int) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id of the documents that links can reach.

    Links are pairs of fingerprints at most ``radius`` bits apart. Repeated rows and ids stay repeated; texts without
    words share the fingerprint zero; documents with a null id link others but never name a component (null if no id
    is left). An empty table gives an empty result; other columns are not read.
    """
    each = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = stored(link_fingerprints(distinct.select("fp"), radius), "links")
    comp = components(edges)
    discard(edges)
    named = distinct.join(comp, distinct.fp == comp.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = named.join(roots, "root").select("fp", "component_id")
    return each.join(final, "fp").select("doc_id", "fp", "component_id")


# ---- similar sets of shingles ----

#: 64-bit words of a sketch. Shingle sets of similarity J have sketches that differ in acos(2J / (1 + J)) / pi of the bits.
SKETCH = 4
SKETCH_COLUMNS = [f"s{k}" for k in range(SKETCH)]
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], dtype=np.uint64)


def differing(similarity: float) -> float:
    """The share of SimHash bits that differ, on average, between sets of a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A SimHash of SKETCH words of the distinct ``hashes``, each widened by mixing; none: zeros."""
    if not len(hashes):
        return np.zeros(SKETCH, dtype=np.uint64)
    h = np.unique(hashes).astype(np.uint64)[:, None] * _MIX
    h = (h ^ h >> np.uint64(29)) * _MIX[::-1]
    h ^= h >> np.uint64(32)
    ones = np.unpackbits(h.view("u1"), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).view(np.uint64)


def _alike(x: np.ndarray, y: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    return common >= similarity * (x + y - common) - 1e-9


class Postings:
    """Which of some sets hold a hash; counts what another set shares with each of them."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owners = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def like(self, s: np.ndarray, similarity: float) -> np.ndarray:
        """Numbers of the sets whose Jaccard similarity with ``s`` is ``similarity`` or more."""
        a, b = np.searchsorted(self.hashes, s), np.searchsorted(self.hashes, s, "right")
        n = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(s) else np.empty(0, dtype=np.int64)
        common = np.bincount(self.owners[at], minlength=len(self.sizes))
        return np.flatnonzero(_alike(len(s), self.sizes, common, similarity) & ((common > 0) | (len(s) + self.sizes == 0)))


def _exact_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` that are alike, by breadth-first search among those not yet reached."""
    left, links, queue = np.arange(len(sets)), [], []
    index, held = Postings(sets), left
    free = np.ones(len(sets), dtype=bool)
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            free[left[0]] = False
        x = queue.pop()
        left = left[free[left]]
        if not len(left):
            break
        if 2 * len(left) <= len(held):
            index, held = Postings([sets[i] for i in left]), left
        for y in held[index.like(sets[x], similarity)]:
            if free[y]:
                free[y] = False
                links.append((x, int(y)))
                queue.append(int(y))
        left = left[free[left]]
    return links


def _cross_links(asks: list[tuple[int, np.ndarray]], rest: list[tuple[int, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """Pairs (place in ``asks``, place in ``rest``) of sets that are alike and have different classes, one pair of two
    classes at most; both hold (class, set)."""
    index, cls, seen, links = Postings([s for _, s in rest]), [c for c, _ in rest], set(), []
    for x, (c, s) in enumerate(asks):
        for y in index.like(s, similarity):
            pair = (min(c, cls[y]), max(c, cls[y]))
            if c != cls[y] and pair not in seen:
                seen.add(pair)
                links.append((x, int(y)))
    return links


def _each_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each run of equal first ``keys`` columns, the last column being a set as bytes."""
    now, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[:keys] != now:
                if rows:
                    yield rows
                now, rows = r[:keys], []
            rows.append((*r[keys:-1], np.frombuffer(r[-1], dtype=np.uint64)))
    if rows:
        yield rows


def _edges_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])


#: A bucket of more sketches makes all of them candidates of each other; no task holds it whole.
BUCKET = 2048
#: Tables whose links are classes before the other tables are read, which then link classes.
FIRST = 4
#: A cluster of more members or hashes than this is compared in blocks.
MEMBERS, HASHES = 1024, 500_000
#: Members of a large cluster that all of its blocks hold.
PIVOTS = 8


#: What a text is known by: two 64-bit hashes.
CONTENT = ["k1", "k2"]


def contents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty), CONTENT and ``more`` of each row."""
    d = documents(docs, *more)
    return d.select("*", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))


def exact_links(docs: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of a cluster with a Jaccard similarity of ``similarity``.

    ``members`` (id long, doc_id, CONTENT, cluster) names texts of ``docs``. A cluster of over MEMBERS or
    HASHES is cut into blocks, each with the same few pivots: what a block links, the pivots join with other blocks.
    Only members outside the cluster's largest class so found then ask the other blocks, in blocks themselves.
    """
    spark = docs.sparkSession

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for b in batches:
            each = [np.unique(shingle_hashes(t, words)).astype(np.uint64) for t in b.column(2).cast(pa.binary()).to_pylist()]
            cols = [b.column(0), b.column(1), pa.array([len(x) for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "cluster", "n", "s"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for rows in _each_group(batches, 2):
            if edges := [(rows[x][0], rows[y][0]) for x, y in _exact_links([r[1] for r in rows], similarity)]:
                yield _edges_batch(edges)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_group(batches, 3):
            asks, rest = ([r for r in rows if r[1] == k] for k in (1, 0))
            found = _cross_links([r[2:] for r in asks], [r[2:] for r in rest], similarity)
            if found:
                yield _edges_batch([(asks[x][0], rest[y][0]) for x, y in found])

    def blocks(total: str, count: str):
        return F.greatest(F.ceil(F.col(total) / HASHES), F.ceil(F.col(count) / MEMBERS)).cast("int")

    def parts(hashes: int) -> int:
        return max(math.ceil(hashes / 2_000_000), int(spark.conf.get("spark.sql.shuffle.partitions")))

    here, named = contents(docs), members.withColumnRenamed("doc_id", "_doc_id").withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    same = here.doc_id.eqNullSafe(named["_doc_id"]) & (here.k1 == named["_k1"]) & (here.k2 == named["_k2"])
    texts = here.join(named.hint("merge"), same).dropDuplicates(["id"]).select("id", "cluster", "text")
    held = stored(texts.mapInArrow(sets, "id long, cluster long, n long, s binary"), "shingle-sets")
    sizes = held.groupBy("cluster").agg(F.sum("n").alias("hashes"), F.count("*").alias("members")).withColumn("blocks", blocks("hashes", "members"))
    large = stored(sizes.where("blocks > 1"), "large-clusters")
    hashes = held.agg(F.sum("n")).first()[0] or 0
    cut = held.join(sent_if_small(large.select("cluster", "blocks", "members")), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    home = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.col("members")) < PIVOTS)
    where = F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))
    dealt = cut.select("cluster", F.explode(where).alias("block"), "id", "s")
    dealt = dealt.repartition(parts(hashes), "cluster", "block").sortWithinPartitions("cluster", "block", "id")
    first = stored(dealt.mapInArrow(within, "u long, v long"), "links")
    if large.isEmpty():
        return first
    found = components(first)
    discard(first)
    first = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    of = cut.where("blocks > 1").join(found.hint("merge"), F.col("id") == F.col("node"), "left")
    of = stored(of.select("cluster", "blocks", "id", "n", "s", F.coalesce("component", "id").alias("class")), "classed-sets")
    classes = of.groupBy("cluster", "class").count()
    most = classes.groupBy("cluster").agg(F.max_by("class", F.struct("count", "class")).alias("most"))
    of = of.join(sent_if_small(most), "cluster")
    asking = of.where("class <> most")
    rounds = asking.groupBy("cluster").agg(F.sum("n").alias("hashes"), F.count("*").alias("members"))
    rounds = stored(rounds.select("cluster", blocks("hashes", "members").alias("rounds")), "asking")
    if rounds.isEmpty():
        return first
    turn = F.pmod(F.xxhash64("id", F.lit(2)), F.col("rounds")).cast("int")
    rounds = sent_if_small(rounds)
    of, asking = (x.join(rounds, "cluster") for x in (of, asking))
    asks = asking.select("cluster", turn.alias("turn"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", F.lit(1).alias("asks"), "class", "s")
    rest = of.select("cluster", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("turn"), home.alias("block"), "id", F.lit(0).alias("asks"), "class", "s")
    n = of.agg(F.sum(F.col("n") * F.col("rounds"))).first()[0] + asking.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]
    pairs = asks.union(rest).repartition(parts(n), "cluster", "turn", "block").sortWithinPartitions("cluster", "turn", "block")
    return first.union(stored(pairs.mapInArrow(across, "u long, v long"), "links"))


def classed_sketches(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, spread: float = 3.0, missed: float = 0.005
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, CONTENT, sketch) of every row, and (sketch, doc_id, class) of every sketch, for links of ``similarity`` or more;
    a sketch is in SKETCH_COLUMNS, and the doc_id beside its class is the smallest (null if none) of its rows.

    Two texts are linked if the Jaccard similarity of their sets of ``words``-word shingles is ``similarity`` or more.
    SimHash sketches of 64 * SKETCH bits only say which sets are compared: they cluster texts that differ in at most
    ``spread`` standard deviations more bits than those at ``similarity`` do on average, and ``exact_links`` compares
    within clusters. So far apart no band of bits need be equal: tables of sampled bits deal the sketches to BK-trees, as
    many that a pair at ``similarity`` is missed by all tables with a chance of ``missed``; the bits a table samples
    follow the number of sketches, so that chance fills no tree. Equal sketches are one before that. A task returns a
    spanning forest, never all pairs. A bucket of over BUCKET sketches is no tree but one cluster, whose members
    ``exact_links`` tells apart. Each table would link the copies of a large group once more; so FIRST tables come first, and
    in the others a sketch stands for its class so far: only links between classes leave a task, none is lost.

    Texts are told apart by content, whatever their ids: ids may be null, repeated, or of any type. ``class`` numbers classes,
    not alike in all runs. Null texts are empty, and all texts without words are one class; very long texts count whole; an
    empty table gives an empty result.
    """

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_words()
        for b in batches:
            rows = [sketch(shingle_hashes(t, words)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            s = np.array(rows, dtype=np.uint64).reshape(-1, SKETCH).view(np.int64)
            cols = [b.column(0), b.column(2), b.column(3), *(pa.array(s[:, k]) for k in range(SKETCH))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *CONTENT, *names])

    names = SKETCH_COLUMNS
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, k1 long, k2 long, " + ", ".join(f"{c} long" for c in names)
    each = stored(contents(docs).mapInArrow(sketches, schema), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *CONTENT)).alias("first")
    distinct = each.groupBy(*names).agg(first).select(*names, "first.doc_id", *(f"first.{c}" for c in CONTENT))
    # Numbers are given where the table is written, once, and read from it ever after.
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-sketches")
    n = distinct.count()
    bits = max(10, math.ceil(math.log2(max(n, 2))) - 2)
    share = differing(similarity)
    tables = math.ceil(math.log(missed) / math.log(1 - (1 - share) ** bits))
    radius = round(BITS * SKETCH * share + spread * math.sqrt(BITS * SKETCH * share * (1 - share)))
    rng = np.random.default_rng(5)
    samples = [rng.choice(BITS * SKETCH, bits, replace=False) for _ in range(tables)]

    def deal(batches: Iterator[pa.RecordBatch], tables: range) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [b.column(c).to_numpy() for c in names]
            bit = np.unpackbits(np.stack(s, axis=1).view("u1"), axis=1)
            for t in tables:
                key = bit[:, samples[t]].astype(np.int64) @ (1 << np.arange(bits))
                cols = [pa.array(np.full(len(key), t, dtype=np.int32)), pa.array(key), b.column("id"), *(pa.array(x) for x in s)]
                yield pa.RecordBatch.from_arrays(cols, ["t", "key", "id", *names])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        all_ = pa.Table.from_batches(got)
        t, key, i, v = (all_.column(c).to_numpy() for c in ("t", "key", "id", "v"))
        tied = v >= 0
        yield pa.RecordBatch.from_arrays([pa.array(i[tied]), pa.array(v[tied])], ["u", "v"])
        rest = np.flatnonzero(~tied)
        if not len(rest):
            return
        order = rest[np.lexsort((i[rest], key[rest], t[rest]))]
        t, key, i = t[order], key[order], i[order]
        value = np.stack([all_.column(c).to_numpy()[order] for c in names], axis=1).view(np.uint64)
        group = np.r_[0, np.cumsum((np.diff(t) != 0) | (np.diff(key) != 0))]
        u, v = (i[x] for x in _links(group, value, np.ones(len(i), dtype=np.int64), radius))
        yield pa.RecordBatch.from_arrays([pa.array(x[u != v]) for x in (u, v)], ["u", "v"])

    def met(nodes: DataFrame, tables: range) -> DataFrame:
        """Edges (u, v) between ids of ``nodes`` (id, names) that ``tables`` link; one id may have many sketches."""
        parts = max(math.ceil(n * len(tables) / 300_000), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = nodes.mapInArrow(partial(deal, tables=tables), "t int, key long, id long, " + ", ".join(f"{c} long" for c in names))
        large = dealt.groupBy("t", "key").agg(F.count("*").alias("count"), F.min("id").alias("v")).where(F.col("count") > BUCKET)
        large = stored(large.select("t", "key", "v"), "large-buckets")
        # A large bucket's rows go to many tasks, each with what it is linked to.
        dealt = dealt.join(sent_if_small(large), ["t", "key"], "left").withColumn("v", F.coalesce("v", F.lit(-1).cast("long"))).where("v <> id")
        salt = F.when(F.col("v") >= 0, F.xxhash64(*names))
        return stored(dealt.repartition(parts, "t", "key", salt).mapInArrow(link, "u long, v long").distinct(), "links")

    begun = components(links := met(distinct.select("id", *names), range(min(FIRST, tables))))
    discard(links)
    nodes = distinct.join(begun.hint("merge"), distinct.id == begun.node, "left").select(F.coalesce("component", "id").alias("id"), *names)
    nodes = stored(nodes, "classed-sketches")
    links = met(nodes, range(FIRST, tables))
    discard(nodes)
    clusters = components(begun.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links)).withColumnRenamed("component", "cluster")
    discard(links)
    members = distinct.join(clusters.hint("merge"), distinct.id == clusters.node).select("id", "doc_id", *CONTENT, "cluster")
    members = stored(members, "members")
    comp = components(exact_links(docs, members, words, similarity))
    classed = distinct.join(comp, distinct.id == comp.node, "left").select(*names, "doc_id", F.coalesce("component", "id").alias("class"))
    return each, stored(classed, "classes")


def similar_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, spread: float = 3.0, missed: float = 0.005) -> DataFrame:
    """(doc_id, CONTENT, component_id, class) of every row: the classes of ``classed_sketches``; component_id is
    the smallest doc_id of the class (null if none has one)."""
    each, classed = classed_sketches(docs, words, similarity, spread, missed)
    # Stored, so that Spark can split a large class's rows in the join.
    least = stored(classed.groupBy("class").agg(F.min("doc_id").alias("component_id")), "least-ids")
    named = classed.drop("doc_id").join(least, "class")
    return each.join(named, SKETCH_COLUMNS).select("doc_id", *CONTENT, "component_id", "class")


def without_copies(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of one row of each class of ``classed_sketches``: that of the smallest doc_id (none counts as the greatest),
    then of the smallest content, then of the smallest other columns. No other row goes, whatever its id."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *CONTENT)).alias("first")
    each, classed = classed_sketches(docs)
    # A class's rows meet in a minimum alone, which combines before the shuffle.
    chosen = each.join(classed.select(*SKETCH_COLUMNS, "class"), SKETCH_COLUMNS).groupBy("class").agg(first)
    chosen = chosen.select(F.col("first.doc_id").alias("_doc_id"), *(F.col(f"first.{c}").alias(f"_{c}") for c in CONTENT))
    rows = docs.select(*columns).withColumns({"_c1": F.xxhash64(F.coalesce("text", F.lit(""))), "_c2": F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))})
    same = rows.doc_id.eqNullSafe(chosen["_doc_id"]) & (rows["_c1"] == chosen["_k1"]) & (rows["_c2"] == chosen["_k2"])
    kept = rows.join(chosen.hint("merge"), same)
    # Rows alike in id and text are left: one of them.
    one = F.min_by(F.struct(*columns), F.struct(*(c for c in columns if c not in ("doc_id", "text"))))
    return kept.groupBy("_c1", "_c2").agg(one.alias("row")).select(*(f"row.{c}" for c in columns))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
