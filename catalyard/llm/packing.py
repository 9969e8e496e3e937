"""Packing token ids into sequences by cutting-stock column generation.

Documents are cut into full sequences and a rest. A linear program over patterns (lengths of rests that fill a sequence)
covers the histogram of rests; a knapsack over the dual prices finds every pattern. Rounded, the patterns are dealt to
rests ranked within their length; the few rests left over are laid end to end and cut at sequence ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, bucket_of, documents, stored, table
from .tokens import _restored, encoder, id_width

CAPACITY = 1024
#: Pieces that one task ranks within a length.
BUCKET = 5000
#: Buckets of a length that one task sums.
GROUP = 4096


def pieces(docs: DataFrame, path: str, spaced: bool, end: int, capacity: int) -> DataFrame:
    """doc_id, start, length, doc_tokens and compressed ids of every document, cut at multiples of ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = encoder(path, spaced), zstandard.ZstdCompressor(1, write_checksum=False).compress
        w = enc.dtype.itemsize
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = enc.encode_ended(b.column(1), end)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
            length = np.minimum(n[doc] - start, capacity)
            at = (np.cumsum(n) - n)[doc] + start
            view = memoryview(ids.tobytes())
            blob = [squeeze(view[w * a : w * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
            cols = [b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(blob, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "doc_tokens", "ids"])

    bounded_batches(docs.sparkSession)
    d = documents(docs)
    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens")]
    return d.mapInArrow(run, T.StructType([d.schema["doc_id"], *long, T.StructField("ids", T.BinaryType())]))


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The best value of each capacity, and the last item taken for it (-1: none)."""
    value, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if k := upto[c]:
            v = prices[:k] + value[c - lengths[:k]]
            j = int(v.argmax())
            if v[j] > value[c] + 1e-12:
                value[c], item[c] = v[j], j
    return value, item


def _pattern(first: int, lengths: np.ndarray, value: np.ndarray, item: np.ndarray, capacity: int) -> dict[int, int]:
    """The best pattern that holds item ``first``: item numbers and how often."""
    out, c = {first: 1}, capacity - int(lengths[first])
    while c > 0 and value[c] > 0:
        if (j := int(item[c])) < 0:
            c -= 1
            continue
        out[j] = out.get(j, 0) + 1
        c -= int(lengths[j])
    return out


@dataclass
class Program:
    """What ``solve_patterns`` did: knapsacks solved, columns that they priced into the program, the program's value in
    sequences, with the price of cuts, and the best bound that prices proved."""

    knapsacks: int = 0
    columns: int = 0
    value: float = 0.0
    bound: float = 0.0


def solve_patterns(
    histogram: dict[int, int], capacity: int, gap: float = 2e-4, most: int = 4000, cut: float = 1 / 128, told: Program | None = None
) -> list[tuple[dict[int, int], int]]:
    """Patterns {length: times} and how many sequences use each, rounded from the linear program's optimum.

    The program has a row for each length. Its first columns lay one piece of a length end to end with others: that costs
    the piece's share of a sequence and, as such a piece is cut with that chance, ``cut`` times the square of the share. All
    patterns come from the knapsack: over the dual prices it finds columns worth more than the sequence they cost, one for
    each length at a time, each of which takes the place of a column (revised simplex). So a pattern leaves at most ``cut``
    of a sequence empty, and what no pattern fills is cut. The search ends when the bound that the prices prove is within
    ``gap`` of the value, or after ``most`` exchanges. Then patterns are rounded down, and up while pieces are left, by
    falling fractions. No length gets more places than ``histogram`` has pieces of it.
    """
    lengths = np.array(sorted(x for x, n in histogram.items() if 0 < x < capacity and n), dtype=np.int64)
    told = told or Program()
    if not len(lengths):
        return []
    demand = np.array([histogram[int(x)] for x in lengths], dtype=float)
    laid = lengths / capacity * (1 + cut * lengths / capacity)
    columns: list[dict[int, int] | None] = [None] * len(lengths)  # None: laid end to end
    inverse, prices, x = np.eye(len(lengths)), laid.copy(), demand.copy()
    value = float(laid @ demand)
    while told.columns < most:
        price = np.maximum(prices, 0)
        worth, item = _knapsack(lengths, price, capacity)
        told.knapsacks += 1
        over = prices / laid
        told.bound = max(told.bound, float(prices @ demand) / max(1.0, worth[capacity], over.max()))
        if value <= (1 + gap) * told.bound:
            break
        best = np.r_[price + worth[capacity - lengths], over]  # patterns that hold a length, and lengths laid end to end
        moved = 0
        for first in np.argsort(-best, kind="stable").tolist():
            if best[first] <= 1 + gap / 2:
                break
            new = _pattern(first, lengths, worth, item, capacity) if first < len(lengths) else None
            at = np.array(list(new)) if new else np.array([first - len(lengths)])
            times = np.array(list(new.values()), dtype=float) if new else np.ones(1)
            cost = (1 if new else float(laid[at[0]])) - float((prices[at] * times).sum())
            if cost > -gap / 4 * (1 if new else laid[at[0]]):  # an exchange before has lowered the prices
                continue
            change = (inverse[:, at] * times).sum(axis=1)
            ratio = np.where(change > 1e-9, x / np.where(change > 1e-9, change, 1), np.inf)
            r = int(ratio.argmin())
            if not np.isfinite(ratio[r]):
                continue
            row = inverse[r] / change[r]
            x -= ratio[r] * change
            x[r] = ratio[r]
            np.maximum(x, 0, out=x)
            value += cost * x[r]
            prices = prices + cost * row
            change[r] = 0
            touched = np.flatnonzero(np.abs(change) > 1e-12)
            inverse[touched] -= np.outer(change[touched], row)
            inverse[r] = row
            columns[r] = new
            moved += 1
        told.columns += moved
        if not moved:
            break
    told.value = value
    used = [r for r in range(len(lengths)) if columns[r]]
    left, rounded = demand.astype(np.int64), np.zeros(len(lengths), dtype=np.int64)

    def take(r: int, n: int) -> None:
        n = min([n, *(int(left[i] // k) for i, k in columns[r].items())])  # rounding errors give no places without pieces
        if n > 0:
            rounded[r] += n
            for i, k in columns[r].items():
                left[i] -= n * k

    for r in used:
        take(r, int(x[r] + 1e-6))
    for r in sorted(used, key=lambda r: (rounded[r] - x[r], r)):
        if x[r] - rounded[r] > 1e-6:
            take(r, 1)
    return [({int(lengths[i]): k for i, k in columns[r].items()}, int(rounded[r])) for r in used if rounded[r]]


class Plan:
    """Where the piece of a length and rank goes. Sequences: those of patterns, full pieces, then what is left over."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        places: dict[int, list[tuple[int, int, int, int]]] = {}  # first rank, times in a sequence, first sequence, offset
        used: dict[int, int] = {}
        sequence = 0
        for pattern, n in solve_patterns(histogram, capacity):
            offset = 0
            for length in sorted(pattern, reverse=True):
                times = pattern[length]
                places.setdefault(length, []).append((used.get(length, 0), times, sequence, offset))
                used[length] = used.get(length, 0) + times * n
                offset += times * length
            sequence += n
        self.full, self.tail = sequence, sequence + histogram.get(capacity, 0)
        rows = [(length, *p) for length in sorted(places) for p in places[length]]
        self.places = np.array(rows, dtype=np.int64).reshape(-1, 5)
        self.key = self.places[:, 0] << 44 | self.places[:, 1]
        self.used = np.array([used.get(length, 0) for length in range(capacity + 1)], dtype=np.int64)
        left = np.array([histogram.get(k, 0) for k in range(capacity + 1)], dtype=np.int64) - self.used
        left[capacity] = 0
        order = np.arange(capacity, -1, -1)
        tokens = (left * np.arange(capacity + 1))[order]
        self.at = np.zeros(capacity + 1, dtype=np.int64)
        self.at[order] = np.cumsum(tokens) - tokens

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece's first id; a piece that goes over the end goes on in the next sequence."""
        cap = self.capacity
        over = rank - self.used[length]
        stream = self.at[length] + over * length
        sequence, offset = self.tail + stream // cap, stream % cap
        full = length == cap
        sequence[full], offset[full] = self.full + rank[full], 0
        regular = (over < 0) & ~full
        if regular.any():
            n, r = length[regular], rank[regular]
            _, first, times, seq, off = self.places[np.searchsorted(self.key, n << 44 | r, "right") - 1].T
            sequence[regular], offset[regular] = seq + (r - first) // times, off + (r - first) % times * n
        return sequence, offset


def pack(docs: DataFrame, path: str, spaced: bool = True, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id and offset of each piece.

    Every id of every document, and ``end`` after each, is in exactly one piece; offsets within a sequence have no gaps.
    Null texts are empty (only the end id); very long texts are many pieces; repeated rows and ids are packed as often as
    they come; other columns are not read; an empty table gives an empty result. Only the histogram of lengths, at most
    ``capacity`` numbers, reaches the driver. Ranks within a length are counted in buckets of about ``BUCKET`` pieces, and
    buckets before a bucket in groups of GROUP, so a length or an id that most documents have is spread like any other; only
    rows equal in id and text share a bucket.
    """
    cut = stored(pieces(docs, path, spaced, end, capacity), "pieces", "none")
    total = cut.count()
    cut = cut.withColumn("tie", F.xxhash64("ids")).withColumn("bucket", bucket_of(max(1, -(-total // BUCKET)), "doc_id", "start", "tie"))
    counts = cut.groupBy("length", "bucket").count().withColumn("group", F.expr(f"bucket div {GROUP}"))
    counts = stored(counts, "length-counts")
    groups = stored(counts.groupBy("length", "group").agg(F.sum("count").alias("n")), "group-counts")
    histogram = {r.length: r.total for r in groups.groupBy("length").agg(F.sum("n").alias("total")).collect()}
    plan, width = Plan(histogram, capacity), id_width(path)
    above = groups.select("length", "group", F.expr("sum(n) over (partition by length order by group) - n").alias("above"))
    within = F.expr("sum(count) over (partition by length, group order by bucket) - count")
    before = counts.withColumn("within", within).join(above, ["length", "group"])
    before = before.select("length", "bucket", (F.col("within") + F.col("above")).alias("before"))
    inside = F.expr("row_number() over (partition by length, bucket order by doc_id, start, tie) - 1")
    ranked = cut.withColumn("inside", inside).join(before.hint("shuffle_merge"), ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("inside") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, length, rank = (b.column(c).to_numpy() for c in ("start", "length", "rank"))
            sequence, offset = plan.place(length, rank)
            here = np.minimum(length, capacity - offset)
            cutting = np.flatnonzero(here < length)
            row = np.r_[np.arange(len(start)), cutting]
            skip = np.r_[np.zeros(len(start), dtype=np.int64), here[cutting]]
            size = np.r_[here, (length - here)[cutting]]
            ids = [np.frombuffer(x, width).astype("<u4") for x in _restored(b.column("ids"))]
            blob = [ids[i][a : a + n].tobytes() for i, a, n in zip(row.tolist(), skip.tolist(), size.tolist())]
            cols = [
                b.column("doc_id").take(pa.array(row)),
                pa.array(start[row] + skip),
                pa.array(size),
                pa.array(blob, pa.binary()),
                b.column("doc_tokens").take(pa.array(row)),
                pa.array(np.r_[sequence, sequence[cutting] + 1]),
                pa.array(np.r_[offset, np.zeros(len(cutting), dtype=np.int64)]),
            ]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(cut.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def packed(docs: DataFrame) -> DataFrame:
    """``pack`` with the byte-level vocabulary: the pieces with their ids, and ids_crc32."""
    found = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("ids_crc32", F.crc32("ids"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).drop("ids")
