"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a context tree over the bytes before it, up to DEPTH. A node counts
zeros and ones and estimates them after Krichevsky and Trofimov; its weighted probability halves between its own estimate
and the product of its children's. A decision's probability mixes the estimates of all depths on its path by those
weights; a path ends where no training text went.

Texts are taken in blocks. A block sends its distinct byte strings (of DEPTH + 1) and words with their counts, in buckets;
buckets are summed in levels of at most FAN blobs, made into trees, and answered block by block. What the model has grows
with the corpus and is never in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_remainder, discard, stored, table

DEPTH = 5
#: Nearest bytes of context that name a bucket; the nodes above that depth are summed over all buckets. With so many fixed,
#: a bucket's strings of one such context are 256 ** (DEPTH + 1 - NEAR) at most, however large the corpus.
NEAR = 3
#: Bytes of text in a block, and blobs that meet in one group.
BLOCK, FAN = 8 << 20, 64
#: Ends each text; no UTF-8 text holds it. Before a text stand zero bytes.
END = b"\xff"
TREE, WORDS = 0, 1


# ---- blobs ----


def packed(sorted_keys: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.diff(sorted_keys, prepend=np.uint64(0)).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "u8"), dtype="u8")


def squeezed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x.tobytes())


def loosened(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


class _Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def tokens_of(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens; the number of each token of the texts, the end (an empty string) included; tokens a text."""
    words = [t.lower().split() for t in texts]
    count = np.array([len(w) + 1 for w in words], dtype=np.int64)
    index = _Numbered()
    flat = map(index.__getitem__, chain.from_iterable(chain(w, (b"",)) for w in words))
    at = np.fromiter(flat, dtype=np.int64, count=int(count.sum()))
    return list(index), at, count


def byte_strings(texts: list[bytes]) -> np.ndarray:
    """For each byte and end of the texts, in order: the byte, and above it the DEPTH bytes before, the nearest lowest."""
    pad = b"\0" * DEPTH
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, END)), dtype="u1")
    key = raw[DEPTH:].astype("u8")
    for k in range(1, DEPTH + 1):
        key |= raw[DEPTH - k : len(raw) - k].astype("u8") << np.uint64(8 * k)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    real = np.ones(len(key), dtype=bool)
    ends = np.cumsum(size + DEPTH)[:-1]  # a text's last position, from where the next one's padding begins
    for k in range(DEPTH):
        real[ends - DEPTH + k] = False
    return key[real]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype("u8")


def bucket_of_keys(keys: np.ndarray, kind: int, n: int) -> np.ndarray:
    """Byte strings with the same NEAR nearest bytes of context are in one bucket."""
    if kind == TREE:
        keys = (keys >> np.uint64(8) & np.uint64((1 << 8 * NEAR) - 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    return (keys % np.uint64(n)).astype(np.int64)


def _bucketed(keys: np.ndarray, kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted ``keys`` by bucket, and where each bucket begins and ends in it."""
    bucket = bucket_of_keys(keys, kind, n)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def _counted(texts: list[bytes], held: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a block's texts and their counts in those not held out (maybe 0)."""
    if kind == WORDS:
        words, at, count = tokens_of(texts)
        seen = np.bincount(at[np.repeat(~held, count)], minlength=len(words))
        keys = _hashes(words)
        order = np.argsort(keys)
        return keys[order], seen[order]
    learn, rest = ([t for t, h in zip(texts, held) if h == side] for side in (False, True))
    keys, seen = np.unique(byte_strings(learn), return_counts=True) if learn else (np.empty(0, "u8"), np.empty(0, "i8"))
    if not rest:
        return keys, seen
    new = np.setdiff1d(np.unique(byte_strings(rest)), keys, assume_unique=True)
    both = np.concatenate([keys, new])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([seen, np.zeros(len(new), dtype=seen.dtype)])[order]


# ---- trees ----


def _log_gamma(x: np.ndarray) -> np.ndarray:
    p = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(p)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1.0)


class Levels:
    """The nodes of depth NEAR to DEPTH of the trees of one bucket, for one of the eight decisions at a time."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts, self.up = {DEPTH: keys}, {DEPTH: counts.astype(float)}, {}
        for d in range(DEPTH - 1, NEAR - 2, -1):
            shorter = self.keys[d + 1] & np.uint64((1 << 8 * (d + 1)) - 1)
            self.keys[d], self.up[d + 1] = np.unique(shorter, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], self.counts[d + 1], len(self.keys[d]))

    def decision(self, j: int) -> dict:
        out: dict = {}
        kids = None
        for d in range(DEPTH, NEAR - 1, -1):
            keys, counts = self.keys[d], self.counts[d]
            name = keys >> np.uint64(8 - j)
            new = np.r_[True, name[1:] != name[:-1]]
            start, node = np.flatnonzero(new), np.cumsum(new) - 1
            one = (keys >> np.uint64(7 - j) & np.uint64(1)).astype(float)
            ones, both = np.add.reduceat(counts * one, start), np.add.reduceat(counts, start)
            own = log_kt(both - ones, ones)
            if kids is None:
                weighted, stay = own, np.ones(len(own))
            else:
                low, where = kids
                below = np.bincount(node[where], low, len(own))
                weighted = np.logaddexp(own, below) - math.log(2)
                stay = np.exp(own - math.log(2) - weighted)
            out[d] = {"node": node, "start": start, "ones": ones, "both": both, "weighted": weighted, "stay": stay}
            if d > NEAR:
                kids = weighted, self.up[d][start]
        return out


def _node(keys: np.ndarray, j: int) -> np.ndarray:
    """The node above depth NEAR that a key's first ``j`` decisions lead to: its nearest NEAR - 1 bytes of context, then the
    beginning of its byte behind a one."""
    byte = keys & np.uint64(255)
    near = keys & np.uint64((1 << 8 * NEAR) - 256)
    return (near | np.uint64(1 << j) | byte >> np.uint64(8 - j)).astype(np.int64)


def top_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For nodes of depth NEAR - 1 (numbered as by ``_node``): zeros, ones and the children's weighted logarithms, as far
    as one bucket knows them."""
    levels, nodes, sums = Levels(keys, counts), [], []
    for j in range(8):
        n = levels.decision(j)[NEAR]
        nodes.append(_node(levels.keys[NEAR][n["start"]], j))
        sums.append((n["both"] - n["ones"], n["ones"], n["weighted"]))
    at, where = np.unique(np.concatenate(nodes), return_inverse=True)
    out = np.array([np.bincount(where, np.concatenate(x), len(at)) for x in zip(*sums)])
    known = out[:2].any(axis=0)
    return at[known], out[:, known]


def top_levels(at: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> list[tuple]:
    """(node, stay, share of ones) of the seen nodes of depths NEAR - 1 to 0, from the sums of all buckets; nodes ascend."""
    order = np.argsort(at)
    at, zeros, ones, below = (x[order] for x in (at, zeros, ones, below))
    out = []
    for d in range(NEAR - 1, -1, -1):
        own = log_kt(zeros, ones)
        weighted = np.logaddexp(own, below) - math.log(2)
        out.append((at, np.exp(own - math.log(2) - weighted), (ones + 0.5) / (zeros + ones + 1)))
        if d:
            at, up = np.unique(at & (1 << 8 * d) - 1, return_inverse=True)
            zeros, ones, below = (np.bincount(up, x, len(at)) for x in (zeros, ones, weighted))
    return out


def log_probabilities(keys: np.ndarray, counts: np.ndarray, top: list[tuple]) -> np.ndarray:
    """log10 of the probability of each key's byte after its context."""
    levels, out = Levels(keys, counts), np.zeros(len(keys))
    byte = (keys & np.uint64(255)).astype(np.int64)
    for j in range(8):
        nodes = levels.decision(j)
        one = byte >> (7 - j) & 1
        at, mixed, seen = np.arange(len(keys)), None, None
        for d in range(DEPTH, NEAR - 1, -1):
            n = nodes[d]
            i = n["node"][at]
            share = (n["ones"] + 0.5) / (n["both"] + 1)
            own = np.where(one == 1, share[i], 1 - share[i])
            stay = n["stay"][i]
            mixed = own if mixed is None else np.where(seen, stay * own + (1 - stay) * mixed, own)
            seen = n["both"][i] > 0
            at = levels.up[d][at]
        node = _node(levels.keys[NEAR - 1], j)
        for d, (names, stays, shares) in zip(range(NEAR - 1, -1, -1), top):
            name = node & (1 << 8 * (d + 1)) - 1
            i = np.searchsorted(names, name).clip(max=max(len(names) - 1, 0))
            known = names[i] == name if len(names) else np.zeros(len(name), dtype=bool)
            stay, share = (np.where(known, x[i] if len(x) else 0.5, 0.5)[at] for x in (stays, shares))
            own = np.where(one == 1, share, 1 - share)
            mixed = np.where(seen, stay * own + (1 - stay) * mixed, own)
            seen = known[at]
        out += np.log10(mixed)
    return out


class Lookup:
    """Values by sorted distinct keys: a first guess by a table of slots, the rest by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        self.keys, self.values, self.shift = keys, values, np.uint64(64 - bits)
        self.slot = np.zeros(1 << bits, dtype=np.int32)
        self.slot[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot[self._slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.values[at]


# ---- jobs ----


def _blocks(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Rows of each block: its texts, and for each kind and bucket its keys and counts."""
    id_type = docs.schema["doc_id"].dataType

    def rows(ids: list, held: list, texts: list[bytes], ids_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        name = uuid4().hex
        schema = pa.schema([
            ("block", pa.string()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()),
            ("doc_ids", pa.list_(ids_type)), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary()),
        ])
        none = {"doc_ids": [None], "held": [None], "sizes": [None], "texts": [None]}
        text = zstandard.ZstdCompressor(6).compress(b"".join(texts))
        own = {"block": [name], "kind": [None], "bucket": [None], "keys": [None], "counts": [None]}
        sizes = [len(t) for t in texts]
        yield pa.RecordBatch.from_pydict(own | {"doc_ids": [ids], "held": [held], "sizes": [sizes], "texts": [text]}, schema)
        for kind in (TREE, WORDS):
            keys, counts = _counted(texts, np.array(held), kind)
            order, cut = _bucketed(keys, kind, n_buckets)
            for b, (x, y) in enumerate(zip(cut, cut[1:])):
                if y > x:
                    part = {"block": [name], "kind": [kind], "bucket": [b], "keys": [packed(keys[order[x:y]])]}
                    part["counts"] = [squeezed(counts[order[x:y]].astype("i8"))]
                    yield pa.RecordBatch.from_pydict(part | none, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, texts, size = [], [], [], 0
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for i, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                ids.append(i), held.append(h), texts.append(t)
                size += len(t) + 100
                if size >= BLOCK:
                    yield from rows(ids, held, texts, kind)
                    ids, held, texts, size = [], [], [], 0
        if texts:
            yield from rows(ids, held, texts, kind)

    schema = T.StructType([
        T.StructField("block", T.StringType()), T.StructField("kind", T.IntegerType()), T.StructField("bucket", T.IntegerType()),
        T.StructField("keys", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(id_type)),
        T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("texts", T.BinaryType()),
    ])
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = np.concatenate([unpacked(x) for x in pdf["keys"]])
    counts = np.concatenate([loosened(x, "i8") for x in pdf["counts"]])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    first = pdf.iloc[0]
    total = np.add.reduceat(counts[order], start)
    return pd.DataFrame({"kind": [first["kind"]], "bucket": [first["bucket"]], "part": [first["part"]], "keys": [packed(keys[start])], "counts": [squeezed(total)]})


def summed(parts: DataFrame, n_blocks: int) -> DataFrame:
    """(kind, bucket, keys, counts): a row for each bucket, summed in levels of groups of about FAN blobs."""
    groups = n_blocks
    now = parts.select("kind", "bucket", "keys", "counts", F.xxhash64("block").alias("part"))
    while True:
        groups = -(-groups // FAN)
        now = now.withColumn("part", F.pmod("part", F.lit(groups)))
        now = now.groupBy("kind", "bucket", "part").applyInPandas(_summed, "kind int, bucket int, part long, keys binary, counts binary")
        now = stored(now, "sums", "none")
        if groups == 1:
            return now


def score(docs: DataFrame, held_out: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and bits_per_byte of every row of ``docs``.

    docs: doc_id, text (null: empty), and the boolean column ``held_out`` (null: true) naming the texts not learned from.
    ``score`` is log10 of the probability that the context trees give a text and its end. Repeated rows are scored, and
    learned from, as often as they come; an empty table gives an empty result; without training texts every bit has
    probability one half. Words are counted by 64-bit hashes. Very long texts are scored whole (one of over BLOCK bytes is a
    block by itself, within the 2 GB that a row may have); a byte's log10 probability is rounded to 32 bits before they are
    added up, which is off by 1e-7 of it; other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n_buckets = int(min(4096, max(48, size // (64 << 20))))
    blocks = stored(_blocks(d, n_buckets), "blocks", "none")
    parts, texts = blocks.where("kind is not null"), blocks.where("kind is null")
    n_blocks = max(1, texts.count())
    sums = summed(parts, n_blocks)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [loosened(x, "i8") for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [int(sum(x.sum() for x in counts))], "v": [int(sum((x > 0).sum() for x in counts))]})

    n, v = sums.where(F.col("kind") == WORDS).select("counts").mapInArrow(totals, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    n, v = n or 0, v or 0

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for keys, counts in zip(*(b.column(i).to_pylist() for i in (0, 1))):
                at, x = top_sums(unpacked(keys), loosened(counts, "i8"))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (at, *x)], ["at", "zeros", "ones", "below"])

    trees = sums.where(F.col("kind") == TREE)
    top = trees.select("keys", "counts").mapInArrow(tops, "at long, zeros double, ones double, below double")
    # A row for each pair of bytes and beginning of a byte that was seen: under 2 ** 24, in text some hundred thousands.
    rows = top.groupBy("at").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toArrow()
    levels = top_levels(*(rows.column(c).to_numpy() for c in ("at", "zeros", "ones", "below")))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, bucket, keys, counts in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "keys", "counts"))):
                if kind == TREE:
                    x = squeezed(log_probabilities(unpacked(keys), loosened(counts, "i8"), levels).astype("f4"))
                else:
                    x = counts
                yield pa.RecordBatch.from_pydict({"kind": [kind], "bucket": [bucket], "keys": [keys], "answers": [x]}, pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("answers", pa.binary())]))

    model = stored(sums.mapInArrow(answers, "kind int, bucket int, keys binary, answers binary"), "model", "none")
    discard(sums)
    model_bytes = model.agg(F.sum(F.octet_length("keys") + F.octet_length("answers"))).first()[0] or 1
    # A bucket's model is copied for each group of blocks. Groups are few enough that all copies are no more than the texts.
    groups = int(max(1, min(-(-n_blocks // FAN), size // model_bytes)))
    copies = model.select("kind", "bucket", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("part"), F.lit(None).cast("string").alias("block"), "keys", "answers")
    asked = parts.select("kind", "bucket", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("part"), "block", "keys", F.lit(None).cast("binary").alias("answers"))

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each group begins with its model; the blocks' keys are answered one after another as they come."""
        known = values = None
        for b in batches:
            out = []
            for kind, bucket, _, block, keys, answer in zip(*(c.to_pylist() for c in b.columns)):
                if block is None:
                    known, values = unpacked(keys), loosened(answer, "f4" if kind == TREE else "i8")
                else:
                    out.append((block, kind, bucket, squeezed(values[np.searchsorted(known, unpacked(keys))])))
            if out:
                types = (pa.string(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["block", "kind", "bucket", "answers"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // 8))
    dealt = copies.unionByName(asked).repartition(tasks, "kind", "bucket", "part")
    dealt = dealt.sortWithinPartitions("kind", "bucket", "part", F.col("block").asc_nulls_first())
    replies = dealt.mapInArrow(reply, "block string, kind int, bucket int, answers binary")
    id_type = d.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r = left.iloc[0]
        got = {(int(k), int(b)): x for k, b, x in zip(right["kind"], right["bucket"], right["answers"])}
        raw, sizes = zstandard.ZstdDecompressor().decompress(r["texts"], max_output_size=int(sum(r["sizes"])) or 1), np.array(r["sizes"], dtype=np.int64)
        ends = np.cumsum(sizes)
        texts = [raw[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist())]

        def answered(keys: np.ndarray, kind: int, dtype: str) -> np.ndarray:
            order, cut = _bucketed(keys, kind, n_buckets)
            out = np.empty(len(keys), dtype=dtype)
            for b, (x, y) in enumerate(zip(cut, cut[1:])):
                if y > x:
                    out[order[x:y]] = loosened(got[kind, b], dtype)
            return out

        strings = byte_strings(texts)
        keys = np.unique(strings)
        logs = Lookup(keys, answered(keys, TREE, "f4"))(strings).astype("f8")
        total = np.add.reduceat(logs, np.r_[0, np.cumsum(sizes + 1)[:-1]])
        words, at, count = tokens_of(texts)
        hashed = _hashes(words)
        order = np.argsort(hashed)
        seen = np.empty(len(words), dtype="i8")
        seen[order] = answered(hashed[order], WORDS, "i8")
        start = np.cumsum(count) - count
        base = np.add.reduceat(np.log10(seen + 1.0)[at], start) - count * math.log10(n + v + 1)
        cols = [r["doc_ids"], r["held"], count, np.add.reduceat((seen > 0)[at].astype("i8"), start), np.full(len(count), n), base, total, sizes]
        return pd.DataFrame(dict(zip(names, cols)))

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
    body = texts.select("block", "doc_ids", "held", "sizes", "texts")
    out = body.groupBy("block").cogroup(replies.groupBy("block")).applyInPandas(finish, schema)
    return out.withColumn("bits_per_byte", F.try_divide(-F.col("score") * math.log2(10), F.col("n_bytes").cast("double")))


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    return score(docs, "held_out")
