"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A fingerprint is the sum, over a text's pieces, of wide vectors hashed from each: LANES lanes of +1 or -1 modulo 2**32,
and WIDE lanes of any value modulo 2**64, all from one BLAKE2b digest. Sums don't depend on order; a piece is inserted or
deleted by adding or subtracting its vector. The narrow lanes tell how like two texts are (an estimate, with a standard
error of about 1 / sqrt(LANES)); the wide lanes, 256 bits, tell whether they are equal. Sums of known hashes don't resist
somebody who makes up texts to collide; chance doesn't make them collide.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, documents, table

LANES, WIDE = 256, 4
#: A line is a paragraph; a longer one is parted after the ends of sentences and clauses.
_PIECE = re.compile(rb"[^\n.!?;:,]*(?:\n|[.!?;:,]+|$)")


#: A piece of more bytes is parted after words that end a run by their own hash, about every fourth.
_LONG = 160


def pieces(text: bytes) -> list[bytes]:
    """The paragraphs of a text, parted at ends of sentences and clauses, and long ones among words; every word is in
    one piece, and where a piece ends depends on its own words alone."""
    out = []
    for p in _PIECE.findall(text):
        if len(p) <= _LONG:
            if p:
                out.append(p)
            continue
        run: list[bytes] = []
        for w in p.split(b" "):
            run.append(w)
            if not crc32(w) & 3:
                out.append(b" ".join(run))
                run = []
        if run:
            out.append(b" ".join(run))
    return out


def _digests(parts: Iterable[bytes]) -> np.ndarray:
    """A row of LANES bits and WIDE 64-bit words, as bytes, for each piece."""
    raw = b"".join([hashlib.blake2b(p).digest() for p in parts])
    return np.frombuffer(raw, dtype="u1").reshape(-1, LANES // 8 + 8 * WIDE)


class Fingerprint:
    """A sum of piece vectors. As text: a digit for the bytes of a narrow lane, as few as hold them all, then the lanes."""

    __slots__ = ("narrow", "wide")

    def __init__(self, narrow: np.ndarray | None = None, wide: np.ndarray | None = None):
        self.narrow = np.zeros(LANES, dtype="i4") if narrow is None else narrow
        self.wide = np.zeros(WIDE, dtype="u8") if wide is None else wide

    @classmethod
    def of(cls, parts: Iterable[bytes]) -> Fingerprint:
        rows = _digests(parts)
        bits = np.unpackbits(rows[:, : LANES // 8], axis=1)
        narrow = (2 * bits.sum(axis=0, dtype=np.int64) - len(rows)).astype("i4")  # modulo 2**32
        return cls(narrow, np.ascontiguousarray(rows[:, LANES // 8 :]).view("u8").sum(axis=0, dtype="u8"))

    @classmethod
    def of_text(cls, text: bytes) -> Fingerprint:
        return cls.of(pieces(text))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.narrow + other.narrow, self.wide + other.wide)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.narrow - other.narrow, self.wide - other.wide)

    def insert(self, part: bytes) -> Fingerprint:
        return self + Fingerprint.of([part])

    def delete(self, part: bytes) -> Fingerprint:
        return self - Fingerprint.of([part])

    def hex(self) -> str:
        size = next(k for k in (1, 2, 4) if k == 4 or (self.narrow.astype(f"i{k}") == self.narrow).all())
        return str(size) + (self.wide.astype(">u8").tobytes() + self.narrow.astype(f">i{size}").tobytes()).hex()

    @classmethod
    def parse(cls, s: str) -> Fingerprint:
        raw = bytes.fromhex(s[1:])
        return cls(np.frombuffer(raw[8 * WIDE :], f">i{s[0]}").astype("i4"), np.frombuffer(raw[: 8 * WIDE], ">u8").astype("u8"))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and bool((self.wide == other.wide).all() and (self.narrow == other.narrow).all())

    __hash__ = None  # type: ignore[assignment]

    def likeness(self, other: Fingerprint) -> float:
        """About the share of pieces that both have (2 * common / all), from 0 to 1; 1 if and only if equal."""
        if self == other:
            return 1.0
        a, b = self.narrow.astype(float), other.narrow.astype(float)
        whole = a @ a + b @ b
        if not whole:
            return 0.0
        return float(min(max(2 * (a @ b) / whole, 0.0), 0.999999))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of ``docs``; null texts are empty, repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [Fingerprint.of_text(t).hex() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    bounded_batches(docs.sparkSession)
    d = documents(docs)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, fingerprint string")


#: Text that a task streams, about; parts are a quarter of it.
TASK_BYTES = 128 << 20


def in_order(docs: DataFrame, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` (doc_id, text) dealt to numbered parts by descending doc_id (nulls last, ties by a hash of the text, then the
    text), as doc_id, text, tie, part and guest; and how many tasks they are for.

    Each part also gets, marked ``guest``, the first document of the next part; the last part gets the first of all. Parts
    are cut by Spark's range partitioning of ids and hashes, of any orderable type and however often an id comes; the driver
    holds one id for each part.
    """
    spark = docs.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    docs = docs.withColumn("tie", F.xxhash64("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))
    cut = docs.select("doc_id", "tie").repartitionByRange(4 * tasks, *order)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "tie"))  # of the rows with the greatest id
    top = cut.select("doc_id", "tie", F.spark_partition_id().alias("p")).groupBy("p", "doc_id").agg(first.alias("f"))
    top = top.groupBy("p").agg(F.max_by(F.struct("doc_id", "f.tie"), F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("head"))
    heads = [(r["head"].doc_id, r["head"].tie) for r in sorted(top.collect())]
    if not heads:
        return docs.select("doc_id", "text", "tie", F.lit(0).alias("part"), F.lit(False).alias("guest")), 1

    def before(a: tuple, b: tuple) -> bool:
        if a[0] == b[0]:
            return a[1] < b[1]
        return b[0] is None or (a[0] is not None and a[0] > b[0])

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for i, t in zip(ids.tolist(), ties.tolist()):
            own, low, high = (None if i is None or i != i else i, t), 0, len(heads)
            while low < high:  # the last head that isn't after the document
                mid = (low + high) // 2
                low, high = (low, mid) if before(own, heads[mid]) else (mid + 1, high)
            out.append(max(low - 1, 0))
        return pd.Series(out, dtype="int32")

    own = docs.select("doc_id", "text", "tie", part_of("doc_id", "tie").alias("part"), F.lit(False).alias("guest"))
    kind = dict(docs.dtypes)["doc_id"]
    to = [(*heads[(p + 1) % len(heads)], p) for p in range(len(heads))]
    to = spark.createDataFrame(to, f"head {kind}, tie long, part int")  # a row for each part
    found = docs.join(F.broadcast(to), (docs.doc_id.eqNullSafe(to["head"])) & (docs.tie == to.tie))
    guests = found.groupBy("part", docs.doc_id, docs.tie).agg(F.min("text").alias("text"), F.lit(True).alias("guest"))
    return own.unionByName(guests), tasks


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document's, as op3's contract has them.

    The next document is the next in descending doc_id (nulls last; rows of one id by a hash of their text, then by text;
    after the last, the first), which may be the document itself if it is alone. Null texts are empty, repeated rows stay,
    ids may be of any orderable type, other columns are not read. The parts are sorted and read as streams: a task holds a
    batch and one document.
    """
    d = documents(docs)
    dealt, n = in_order(d)
    ordered = dealt.repartition(n, "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "tie", "text")
    ordered = ordered.select("doc_id", "text", "part", "guest")
    kinds = dict(d.dtypes)["doc_id"]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            out = []
            cols = (b.column(i).to_pylist() for i in range(4))
            for doc_id, text, _, guest in zip(*cols):
                fp = Fingerprint.of_text(text.encode())
                if before is not None:
                    old_id, old, old_fp = before
                    k = len(old) // 3
                    edited = (old[: len(old) - k] + text[:k]).encode()
                    efp = Fingerprint.of_text(edited)
                    digest = hashlib.sha256(edited).hexdigest()
                    out.append((old_id, len(old), digest, old_fp.hex(), efp.hex(), old_fp.likeness(efp), old_fp.likeness(fp)))
                before = None if guest else (doc_id, text, fp)
            if out:
                types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    bounded_batches(docs.sparkSession)
    schema = f"doc_id {kinds}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.mapInArrow(run, schema)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
