"""Token ids: encoding through a word cache, and a binary format of frequency-ranked ids.

Format. A row is a block of consecutive documents, in order: ``doc_ids`` and the ids of each (``counts``), ``control``
and ``data``. Ids are replaced by their rank among all ids by falling frequency. A rank takes one to four bytes of
``data``, little-endian; ``control`` has two bits for each rank, four to a byte from the low end: its length less one.
``decode`` reads a control byte's lengths from a table and gathers all ranks at once. The ranking is stored beside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .common import bounded_batches, discard, documents, shared_dir, stored, table

#: Unicode's White_Space, which is what the tokenizers' patterns take as \s, but for space and line end.
_ODD_WHITE = "\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[ \n{_ODD_WHITE}]*[^ \n{_ODD_WHITE}]+|[ \n{_ODD_WHITE}]+")
#: Texts with other white space than single spaces and line ends between words (RE2 syntax).
_ODD_INSIDE = "[ \\n][ \\n]|[ \\n]$|[\\x00\\t\\x0b-\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_ODD = "^[ \\n]|" + _ODD_INSIDE
#: The same for texts that all begin with a space of their own.
_ODD_LED = "^\\n|" + _ODD_INSIDE
#: A letter and a sign after it, between which all vocabularies part; for fewer distinct units. Without U+0130, which in lower
#: case ends in a mark that goes with the sign.
_SIGNED = r"([A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}])([!-&(-/:-@\[-`{-~])"
#: Units that a worker remembers.
CACHE = 800_000


class Encoder:
    """Encodes texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does, each distinct word once.

    A unit is a word with the white space before it (``spaced``: for vocabularies whose pieces keep white space) or a
    word alone (for those that drop it and lower-case). No piece crosses a unit's ends, so the ids of its units are the
    ids of a text. Texts that hold the string of a special token, in any case, are given to the tokenizer whole.
    ``cache``: units that are remembered (CACHE).
    """

    odd, step = _ODD, 100  # units that are encoded in one call

    def __init__(self, path: str, spaced: bool, cache: int | None = None):
        self.spaced, self.plain, self.cache = spaced, Tokenizer.from_file(path), cache
        added = self.plain.get_added_tokens_decoder()
        self.marks = sorted({t.content.lower() for t in added.values()})
        self.mark_id, self.mark = next(((i, t.content) for i, t in added.items() if t.special), (None, ""))
        self.dtype = np.dtype("<u2" if self.plain.get_vocab_size() <= 1 << 16 else "<u4")
        self._start()

    def _start(self) -> None:
        self.index: dict[bytes, int] = {}
        self.n, self.strange = 0, 0
        self.flat, self.ends = np.empty(1 << 20, dtype=self.dtype), np.zeros(1 << 18, dtype=np.int32)  # unit i: flat[ends[i] : ends[i + 1]]

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's; many texts go in one call, parted by a special token."""
        if self.mark:
            joined = self.mark.encode().join(texts).decode()
            ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=np.int64)
            cuts = np.r_[-1, np.flatnonzero(ids == self.mark_id), len(ids)]
            if len(cuts) == len(texts) + 1:
                return ids[ids != self.mark_id], np.diff(cuts) - 1
        ids = [e.ids for e in self.plain.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], dtype=np.int64), np.array([len(x) for x in ids])

    def _learn(self, new: list[bytes]) -> None:
        for a in range(0, len(new), self.step):
            some = new[a : a + self.step]
            ids, n = self._encoded(some)
            used = int(self.ends[self.n])
            while used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while self.n + len(some) >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.empty_like(self.ends)])
            self.flat[used : used + len(ids)] = ids
            self.ends[self.n + 1 : self.n + 1 + len(some)] = used + np.cumsum(n)
            self.n += len(some)

    def _numbers(self, distinct: list[bytes]) -> np.ndarray:
        """Numbers of units, which are all encoded now. What goes over the cache is forgotten at the next call."""
        index, kept, most = self.index, len(self.index), self.cache or CACHE
        self.n = kept
        number = np.fromiter(map(index.get, distinct, repeat(-1)), dtype=np.int32, count=len(distinct))
        at = np.flatnonzero(number < 0)
        new = [distinct[i] for i in at.tolist()]
        # A cache of words that most texts no longer have is given up.
        self.strange = self.strange + 1 if kept + len(new) > most and 3 * len(new) > 2 * len(distinct) else 0
        if self.strange > 4:
            self._start()
            return self._numbers(distinct)
        self._learn(new)
        number[at] = np.arange(kept, self.n)
        index.update(zip(new[: max(most - kept, 0)], range(kept, self.n)))
        return number

    def _of_units(self, units: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts that have ``count`` of the ``units`` each, and the number of each text's."""
        coded = pc.dictionary_encode(units.cast(pa.binary()))
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        known = pa.ListArray.from_arrays(pa.array(self.ends[: self.n + 1]), pa.array(self.flat[: self.ends[self.n]]))
        lists = known.take(pa.array(number[coded.indices.to_numpy()]))
        upto = lists.offsets.to_numpy()[np.r_[0, np.cumsum(count)]]
        return lists.flatten().to_numpy(), np.diff(upto).astype(np.int64)

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of ordinary texts, and the number of each text's."""
        if self.spaced:  # single spaces and line ends, between words; they go to the word after them
            cut = pc.replace_substring_regex(texts, _SIGNED, "\\1\0\\2")
            lists = pc.split_pattern(pc.replace_substring(pc.replace_substring(cut, " ", "\0 "), "\n", "\0\n"), "\0")
        else:
            lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _SIGNED, "\\1 \\2"))
        units, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
        if not self.spaced:  # the tokenizer composes letters and marks before it lowers them, so only ASCII is lowered here
            units = pc.if_else(pc.string_is_ascii(units), pc.ascii_lower(units), units)
        return units, count

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the ``texts`` (strings, no nulls), one text after another, and the number of each text's."""
        if not len(texts):
            return np.empty(0, dtype=self.dtype), np.empty(0, dtype=np.int64)
        lower = pc.ascii_lower(texts)
        whole = np.zeros(len(texts), dtype=bool)
        for m in self.marks:
            whole |= pc.match_substring(lower, m).to_numpy(False)
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(False) & ~whole if self.spaced else np.zeros_like(whole)
        usual = ~(whole | odd)
        if usual.all():
            return self._of_units(*self._split(texts))
        parts: list = [None] * len(texts)

        def put(where: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
            for i, x in zip(where.tolist(), np.split(ids, np.cumsum(n)[:-1])):
                parts[i] = x

        if usual.any():
            put(np.flatnonzero(usual), *self._of_units(*self._split(texts.filter(pa.array(usual)))))
        if odd.any():
            units = [_UNIT.findall(t) for t in texts.filter(pa.array(odd)).to_pylist()]
            flat = pa.array([u for x in units for u in x], pa.string())
            put(np.flatnonzero(odd), *self._of_units(flat, np.array([len(x) for x in units])))
        for i in np.flatnonzero(whole).tolist():
            parts[i] = np.array(self.plain.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=self.dtype)
        return np.concatenate(parts).astype(self.dtype), np.array([len(x) for x in parts], dtype=np.int64)

    def encode_ended(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with the id ``end`` after each text's."""
        ids, n = self.encode(texts)
        return np.insert(ids, np.cumsum(n), end), n + 1


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """One for each worker process."""
    if (path, spaced) not in _encoders:
        _encoders[path, spaced] = Encoder(path, spaced)
    return _encoders[path, spaced]


def encoded(docs: DataFrame, path: str, spaced: bool, end: int, *more: str) -> DataFrame:
    """doc_id, n_tokens, ids (16 or 32 bits each, little-endian, compressed one by one) and ``more``; ``end`` follows each
    document's ids.

    Whole texts are encoded; null texts are empty and have only the end id. Repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, squeeze = encoder(path, spaced), zstandard.ZstdCompressor(1, write_checksum=False).compress
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = enc.encode_ended(b.column(1), end)
            view, upto = memoryview(ids.tobytes()), (np.cumsum(n) * enc.dtype.itemsize).tolist()
            blob = pa.array([squeeze(view[a:z]) for a, z in zip([0, *upto], upto)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), blob, *b.columns[2:]], ["doc_id", "n_tokens", "ids", *more])

    bounded_batches(docs.sparkSession)
    d = documents(docs, *more)
    rest = [d.schema[c] for c in more]
    fields = [d.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), *rest]
    return d.mapInArrow(run, T.StructType(fields))


def id_width(path: str) -> np.dtype:
    return np.dtype("<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4")


# ---- the file format ----

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit ``ranks``."""
    size = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF).astype(np.int64)
    code = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    code[: len(ranks)] = size - 1
    control = code.reshape(-1, 4) @ np.array([1, 4, 16, 64], dtype=np.uint8)
    wide = ranks.astype("<u4").view("u1").reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), wide[np.arange(4) < size[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of ``encode_ranks``."""
    size = _LENGTHS[np.frombuffer(control, "u1")].reshape(-1)[:n]
    start = np.cumsum(size) - size
    padded = np.frombuffer(data + b"\0\0\0", "u1").astype(np.uint32)
    out = padded[start] if n else np.zeros(0, dtype=np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        more = size > k
        out[more] |= padded[start[more] + k] << np.uint32(8 * k)
    return out


def _blocks(parts: Iterator[pa.RecordBatch], rank: np.ndarray, dtype: np.dtype, most: int) -> Iterator[tuple]:
    """(doc_ids, counts, control, data) of blocks of ``most`` ids or a document more."""
    ids, docs, held = [], [], 0

    def block() -> tuple:
        control, data = encode_ranks(rank[np.concatenate(ids)])
        return list(docs), [len(x) for x in ids], control, data

    for b in parts:
        for doc_id, blob in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
            ids.append(np.frombuffer(blob, dtype))
            docs.append(doc_id)
            held += len(ids[-1])
            if held >= most:
                yield block()
                ids, docs, held = [], [], 0
    if docs:
        yield block()


#: Ids that a task of the second pass packs, about.
PART_IDS = 16 << 20


def write_tokens(docs: DataFrame, where: str, path: str, spaced: bool = False, end: int = 1, block: int = 1 << 18) -> None:
    """Encodes ``docs`` (doc_id, text) and writes ``where``/blocks and ``where``/ranking, in ascending doc_id order.

    Nulls come first; rows with one doc_id go by a hash of their ids, so that reruns agree and a repeated doc_id is spread
    over tasks. Null texts are empty and have only the end id; whole texts are encoded, and one of more than ``block`` ids
    is a block by itself; other columns are not read. An empty table gives an empty ranking and no blocks.

    Encoded texts are written once; ids are counted, and ranked, over all of them (the ranking is as long as the
    vocabulary). A second pass sorts by range, ranks and packs, in tasks of about ``PART_IDS`` ids. Rows of ``blocks`` are
    numbered by ``part``, the range, and ``at`` within it.
    """
    spark = docs.sparkSession
    width = id_width(path)
    size = 1 << 8 * width.itemsize if width.itemsize == 2 else Tokenizer.from_file(path).get_vocab_size()
    raw = stored(encoded(docs, path, spaced, end), "tokens", "none")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=np.int64)
        for b in batches:
            if b.num_rows:
                seen += np.bincount(np.frombuffer(b"".join(_restored(b.column(0))), width), minlength=size)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at], pa.int64())], ["id", "n"])

    counts = raw.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counts.orderBy(F.col("n").desc(), "id").collect()  # at most a row for each vocabulary entry
    rank = np.zeros(size, dtype=np.uint32)
    rank[[r.id for r in ranked]] = np.arange(len(ranked), dtype=np.uint32)
    spark.createDataFrame([([r.id for r in ranked],)], "ids array<int>").write.parquet(f"{where}/ranking")
    kind = dict(docs.dtypes)["doc_id"]
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    row_type = pa.schema([
        ("part", pa.int32()), ("at", pa.int32()), ("doc_ids", pa.list_(id_type)), ("counts", pa.list_(pa.int32())), ("control", pa.binary()), ("data", pa.binary()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        plain = (_plain(b) for b in batches)
        for at, (doc_ids, counts, control, data) in enumerate(_blocks(plain, rank, width, block)):
            row = {"part": [part], "at": [at], "doc_ids": [doc_ids], "counts": [counts], "control": [control], "data": [data]}
            yield pa.RecordBatch.from_pydict(row, row_type)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r.n for r in ranked) // PART_IDS))
    schema = f"part int, at int, doc_ids array<{kind}>, counts array<int>, control binary, data binary"
    tied = raw.select("doc_id", "ids", F.xxhash64("ids").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    ordered.mapInArrow(pack, schema).write.option("compression", "zstd").parquet(f"{where}/blocks")
    discard(raw)


def _restored(col: pa.Array) -> list[bytes]:
    plain = zstandard.ZstdDecompressor().decompress
    return [plain(x) for x in col.to_pylist()]


def _plain(b: pa.RecordBatch) -> pa.RecordBatch:
    return b.set_column(b.schema.get_field_index("ids"), "ids", pa.array(_restored(b.column("ids")), pa.binary()))


def read_tokens(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from files of ``write_tokens``; ids are unsigned 32-bit integers, little-endian,
    and start counts the ids of all documents before."""
    by_rank = np.array(spark.read.parquet(f"{where}/ranking").first().ids, dtype="<u4")
    blocks = spark.read.parquet(f"{where}/blocks")
    # Ids before a block: those of earlier parts (a row for each part) and of earlier blocks of its part.
    count = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    sized = blocks.select("part", "at", count.alias("n"))
    w = "(partition by part order by at rows between unbounded preceding and current row)"
    inside = sized.select("part", "at", F.expr(f"sum(n) over {w} - n").alias("inside"))
    parts = sized.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", F.expr("sum(n) over (order by part) - n").alias("before"))
    starts = inside.join(before, "part").select("part", "at", (F.col("inside") + F.col("before")).alias("start"))
    kind = dict(blocks.dtypes)["doc_ids"][6:-1]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                counts = np.array(r["counts"], dtype=np.int64)
                ids = by_rank[decode_ranks(r["control"], r["data"], int(counts.sum()))]
                ends = np.cumsum(counts)
                blob = [x.tobytes() for x in np.split(ids, ends[:-1])]
                cols = [r["doc_ids"], (r["start"] + ends - counts).tolist(), counts.tolist(), blob]
                types = [b.schema.field("doc_ids").type.value_type, pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "start", "n_tokens", "ids"])

    bounded_batches(spark)
    joined = blocks.join(starts, ["part", "at"])
    return joined.mapInArrow(unpack, f"doc_id {kind}, start long, n_tokens long, ids binary")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), where, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, where).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
