"""Alignment of two tokenizers' tokens over the same bytes, by divide and conquer at shared cuts.

Both tokenizations of a text end some tokens at the same bytes. An interval is parted at the shared end nearest its middle, which
is looked up by bisection, and both halves in the same way; an interval without a shared end inside is a group. The intervals
of many texts are parted level by level together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, documents, stored, table
from .tokens import _ODD_LED, Encoder, decode_ranks, encode_ranks

#: Bytes of text in a block, and of those that are aligned together; words that a worker remembers.
BLOCK, STEP, CACHE = 12 << 20, 1 << 19, 600_000


class BothEncoder(Encoder):
    """Encodes a space and a text by both vocabularies at once: A's ids, and B's after A's last id. Strings of special tokens are
    plain text. A unit whose tokens don't spell its bytes has the one id ``bad``."""

    odd, step = _ODD_LED, 1000

    def __init__(self, path_a: str, path_b: str):
        super().__init__(path_a, True, CACHE)
        self.marks, self.mark, self.plain.encode_special_tokens = [], "", True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocab, n_b = self.plain.get_vocab(), self.pieces.get_piece_size()
        self.n_a, self.n_b = max(vocab.values()) + 1, n_b
        self.bad, self.dtype = self.n_a + n_b, np.dtype("<u4")
        #: Bytes of each id: a character of A's entries stands for a byte.
        self.size = np.zeros(self.n_a + n_b, dtype=np.int64)
        self.size[list(vocab.values())] = list(map(len, vocab))
        names = map(self.pieces.id_to_piece, range(n_b))
        self.size[self.n_a :] = [1 if self.pieces.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(names)]
        self._start()

    def _pieces_of(self, texts: list[bytes]) -> list[list[int]]:
        """B puts a space before a text, so a unit's own is left to it; other units, and a lone space, stand after a line end,
        whose tokens are cut off."""
        own = [t[:1] == b" " and len(t) > 1 for t in texts]
        ids = self.pieces.encode([t[1:].decode() if o else "\n" + t.decode() for t, o in zip(texts, own)], num_threads=1)
        return [x if o else x[2:] for x, o in zip(ids, own)]

    def _encoded(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        a = [e.ids for e in self.plain.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        b = self._pieces_of(texts)
        want = np.array(list(map(len, texts)))
        n_a, n_b = np.array(list(map(len, a))), np.array(list(map(len, b)))
        flat_a, flat_b = np.array([i for x in a for i in x], dtype=np.int64), np.array([i for x in b for i in x], dtype=np.int64) + self.n_a
        spelled = [np.diff(np.r_[0, np.cumsum(self.size[x])][np.r_[0, np.cumsum(n)]]) for x, n in ((flat_a, n_a), (flat_b, n_b))]
        # U+2581 reads as a space, which is shorter: such units differ in size.
        good = (spelled[0] == want) & (spelled[1] == want)
        if (unknown := flat_b == self.n_a + self.pieces.unk_id()).any():
            good[np.repeat(np.arange(len(texts)), n_b)[unknown]] = False
        if good.all():
            at_b = np.repeat(np.cumsum(n_a), n_b) + np.arange(len(flat_b))  # a unit's ids of B come after its ids of A
            out = np.empty(len(flat_a) + len(flat_b), dtype=np.int64)
            rest = np.ones(len(out), dtype=bool)
            rest[at_b] = False
            out[at_b], out[rest] = flat_b, flat_a
            return out, n_a + n_b
        ids = [[*x, *(i + self.n_a for i in y)] if g else [self.bad] for x, y, g in zip(a, b, good.tolist())]
        return np.array([i for x in ids for i in x], dtype=np.int64), np.array(list(map(len, ids)))


def shared_cuts(a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which tokens of A end at a shared cut. ``a`` and ``b`` are ascending ends of tokens; ``last`` are the places in ``a`` of
    ends known to be shared, ascending, the final token's among them."""
    cut = np.zeros(len(a), dtype=bool)
    cut[last] = True
    lo, hi = np.r_[0, last[:-1] + 1], last + 1
    at = np.searchsorted(b, a[last]) + 1
    blo, bhi = np.r_[0, at[:-1]], at
    while True:
        open_ = (hi - lo > 1) & (bhi - blo > 1)
        lo, hi, blo, bhi = lo[open_], hi[open_], blo[open_], bhi[open_]
        if not len(lo):
            return cut
        middle, found = (lo + hi) // 2 - 1, np.full(len(lo), -1)
        there = np.zeros(len(lo), dtype=np.int64)
        pending, step = np.arange(len(lo)), 0
        while len(pending):
            if step > 64:  # long intervals, few: all ends of one at once
                for i in pending.tolist():
                    ends = np.arange(lo[i], hi[i] - 1)
                    p = blo[i] + np.searchsorted(b[blo[i] : bhi[i]], a[ends])
                    hit = np.flatnonzero(b[p] == a[ends])
                    if len(hit):
                        best = hit[np.argmin(np.abs(ends[hit] - middle[i]))]
                        found[i], there[i] = ends[best], p[best]
                break
            far = (step + 1) // 2
            end = middle[pending] + (far if step % 2 else -far)
            inside = (end >= lo[pending]) & (end < hi[pending] - 1)
            p = np.searchsorted(b, a[np.where(inside, end, 0)])
            hit = inside & (b[p] == a[np.where(inside, end, 0)])
            found[pending[hit]], there[pending[hit]] = end[hit], p[hit]
            left = ~hit & ((middle[pending] - far >= lo[pending]) | (middle[pending] + far < hi[pending] - 1))
            pending, step = pending[left], step + 1
        some = found >= 0
        f, t = found[some], there[some]
        cut[f] = True
        lo, hi = np.r_[lo[some], f + 1], np.r_[f + 1, hi[some]]
        blo, bhi = np.r_[blo[some], t + 1], np.r_[t + 1, bhi[some]]


class Digits:
    """Writes ids in decimals, each with a sign after it."""

    def __init__(self, most: int):
        self.width = len(str(most)) + 1
        names = [str(i).encode() for i in range(most + 1)]
        self.size = np.array(list(map(len, names)), dtype=np.uint8)
        self.table = np.frombuffer(b"".join(x.ljust(self.width, b"\0") for x in names), np.uint8).reshape(-1, self.width)

    def write(self, ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and how many come before each id and after all."""
        out, size = self.table[ids], self.size[ids]
        out[np.arange(len(ids)), size] = signs
        return out[np.arange(self.width) <= size[:, None]], np.r_[0, np.cumsum(size + np.int64(1))]


class Aligner:
    """A worker's encoder, and its table of digits."""

    def __init__(self, path_a: str, path_b: str):
        self.both = BothEncoder(path_a, path_b)
        self.digits = Digits(max(self.both.n_a, self.both.n_b) - 1)

    def align(self, texts: pa.Array) -> dict[str, np.ndarray | list[str]]:
        """n_a, n_b, n_groups, n_links and sha of each text (strings, no nulls), and ``pairs`` (A id x ids of B + B id) of all
        links, text after text. Texts that are empty or whose tokens spell other bytes have none."""
        n, both = len(texts), self.both
        ids, count = both.encode(pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" ")))
        doc = np.repeat(np.arange(n), count)
        none = np.bincount(doc[ids == both.bad], minlength=n) > 0
        none |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        if none.any():
            left = ~none[doc]
            ids, doc = ids[left], doc[left]
        of_b = ids >= both.n_a
        ids_a, ids_b = ids[~of_b].astype(np.int64), ids[of_b].astype(np.int64) - both.n_a
        n_a, n_b = np.bincount(doc[~of_b], minlength=n), np.bincount(doc[of_b], minlength=n)
        out = {"n_a": n_a, "n_b": n_b, "n_groups": np.zeros(n, np.int64), "n_links": np.zeros(n, np.int64), "sha": [""] * n, "pairs": np.empty(0, np.uint32)}
        full = np.flatnonzero(n_a)
        if not len(full):
            return out
        a, b = np.cumsum(both.size[ids_a]), np.cumsum(both.size[ids_b + both.n_a])
        last = np.cumsum(n_a[full]) - 1
        cut = shared_cuts(a, b, last)
        cuts = np.flatnonzero(cut)
        cuts_b = np.searchsorted(b, a[cuts])
        groups = np.diff(np.r_[0, np.searchsorted(cuts, last) + 1])
        out["n_groups"][full] = groups
        out["n_links"][full] = n_a[full] + n_b[full] - groups
        cut_b = np.zeros(len(b), dtype=bool)
        cut_b[cuts_b] = True
        # All ends in order, each once: those of A, and B's own. Between neighbours, one token of each covers the bytes: a link.
        own = np.flatnonzero(~cut_b)
        from_b = np.zeros(len(a) + len(own), dtype=bool)
        from_b[np.searchsorted(a, b[own]) + np.arange(len(own))] = True
        ends_b = from_b.copy()
        ends_b[~from_b] = cut
        place = lambda ends: np.cumsum(ends) - ends  # noqa: E731  how many ends come before: the token that covers the bytes
        out["pairs"] = ids_a[place(~from_b)].astype(np.uint64) * np.uint64(both.n_b) + ids_b[place(ends_b)].astype(np.uint64)
        # In writing, a group's tokens of A come before its tokens of B.
        place_a = np.arange(len(a)) + np.r_[0, cuts_b + 1][np.cumsum(cut) - cut]
        place_b = np.arange(len(b)) + (cuts + 1)[np.cumsum(cut_b) - cut_b]
        ids = np.empty(len(a) + len(b), dtype=np.int64)
        ids[place_a], ids[place_b] = ids_a, ids_b
        signs = np.full(len(ids), ord(","), dtype=np.uint8)
        signs[place_a[cuts]], signs[place_b[cuts_b]] = ord("|"), ord(";")
        text, upto = self.digits.write(ids, signs)
        view, stop = memoryview(text), np.cumsum((n_a + n_b)[full])
        for i, x, z in zip(full.tolist(), upto[np.r_[0, stop[:-1]]].tolist(), upto[stop].tolist()):
            out["sha"][i] = hashlib.sha256(view[x : z - 1]).hexdigest()
        return out


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def _steps(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Runs of texts of about ``most`` bytes, or a text more."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def align_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each block of ``docs`` (doc_id, text), of BLOCK bytes or a document more: its key, doc_ids, COUNTS and sha of each
    document, the distinct pairs and how often it links them (``times``), most frequent first, and its links in order, as places
    among these pairs (``control`` and ``data``, as in token files)."""
    kind = dict(docs.dtypes)["doc_id"]
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    ints = pa.list_(pa.int64())
    fields = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(id_type)), *((c, ints) for c in COUNTS), ("sha", pa.list_(pa.string())), ("pairs", ints), ("times", ints), ("control", pa.binary()), ("data", pa.binary())])

    def block(ids: list, held: list[dict]) -> pa.RecordBatch:
        code, pairs = pd.factorize(np.concatenate([h["pairs"] for h in held]))
        times = np.bincount(code, minlength=len(pairs))
        order = np.lexsort((pairs, -times))
        rank = np.empty(len(pairs), dtype=np.uint32)
        rank[order] = np.arange(len(pairs), dtype=np.uint32)
        control, data = encode_ranks(rank[code])
        row = {"block": uuid4().hex, "doc_ids": ids, "sha": [x for h in held for x in h["sha"]], "pairs": pairs[order].astype(np.int64), "times": times[order]}
        row |= {c: np.concatenate([h[c] for h in held]) for c in COUNTS} | {"control": zstandard.compress(control, 3), "data": zstandard.compress(data, 3)}
        return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(path_a, path_b)
        ids, held, size = [], [], 0
        for b in batches:
            at = 0
            for some in _steps(b.column(1), STEP):
                ids += b.column(0).slice(at, len(some)).to_pylist()
                held.append(al.align(some))
                at, size = at + len(some), size + some.nbytes
                if size >= BLOCK:
                    yield block(ids, held)
                    ids, held, size = [], [], 0
        if ids:
            yield block(ids, held)

    bounded_batches(docs.sparkSession)
    array = "array<long>"
    schema = f"block string, doc_ids array<{kind}>, {', '.join(f'{c} {array}' for c in COUNTS)}, sha array<string>, pairs {array}, times {array}, control binary, data binary"
    return documents(docs).mapInArrow(run, schema)


def align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of ``docs``
    (doc_id, text); and a_id, b_id, n, how many links hold a pair, over all of them.

    A, a byte-level vocabulary, encodes a space and the text; B, of pieces, the text. Texts that are null or empty, or that
    either one's tokens don't spell, have zeros and an empty digest. n_best counts links whose pair is as frequent as their B
    id's most frequent; count_sum adds up their pairs' counts. Whole texts are read; repeated rows are rows like any other;
    an empty table gives empty results; other columns are not read.

    Texts are tokenized once, and their links kept as numbers in blocks of ``BLOCK`` bytes or a document more. A block asks for
    the counts of its own distinct pairs, so what is shuffled is those and the blocks, not the links. The most frequent pairs of
    B's ids are a row for each entry of B's vocabulary. A task holds one block at a time.
    """
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    blocks = stored(align_blocks(docs, path_a, path_b), "aligned")
    asked = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "times"))).select("block", "pos", F.col("col.pairs").alias("pair"), F.col("col.times").alias("times"))
    counts = stored(asked.groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    b_id = F.col("pair") % n_b
    best = counts.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("best"))  # as long as B's vocabulary
    known = counts.join(F.broadcast(best), b_id == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    answers = asked.select("block", "pos", "pair").join(known.hint("merge"), "pair")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("pos", "n", "is_best")).alias("answers"))  # a block's own pairs
    kind = dict(blocks.dtypes)["doc_ids"][6:-1]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for k in range(b.num_rows):
                values = lambda c, k=k: b.column(c)[k].values  # noqa: B023, E731
                found = values("answers")
                pos, n, is_best = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3)) if found is not None else [np.empty(0, np.int64)] * 3
                of, top = np.zeros(len(pos), np.int64), np.zeros(len(pos), bool)
                of[pos], top[pos] = n, is_best
                counts = [values(c).to_numpy() for c in COUNTS]
                upto = np.r_[0, np.cumsum(counts[3])]
                links = decode_ranks(plain(b.column("control")[k].as_py()), plain(b.column("data")[k].as_py()), int(upto[-1]))
                sums = [np.diff(np.r_[0, np.cumsum(x[links])][upto]).astype(np.int64) for x in (top.astype(np.int64), of)]
                cols = [values("doc_ids"), *map(pa.array, [*counts, *sums]), values("sha")]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"])

    joined = blocks.drop("pairs", "times").join(answers.hint("merge"), "block", "left")
    schema = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, n_best long, count_sum long, groups_sha256 string"
    pairs = counts.select(F.expr(f"pair div {n_b}").alias("a_id"), b_id.alias("b_id"), "n")
    return joined.mapInArrow(finish, schema), pairs


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(table(spark, sf_dir, "documents"), *paths)[0]
