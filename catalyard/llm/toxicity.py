"""Toxicity: a linear classifier of words that is penalised where swapping identity terms changes its score."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, crc_remainder, discard, documents, stored, table

#: Identity terms by language and kind, of one word each. A term is swapped for the others of its kind.
IDENTITY_TERMS = {
    "gender": ["man", "woman", "men", "women", "male", "female", "transgender", "nonbinary"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "heterosexual", "homosexual", "queer"],
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist", "sikh"],
    "origin": ["african", "american", "asian", "european", "mexican", "chinese", "indian", "arab", "turkish", "polish"],
    "colour": ["black", "white", "brown", "latino", "latina"],
    "age": ["young", "old", "elderly", "teenage"],
    "ability": ["blind", "deaf", "disabled", "autistic"],
    "gender, de": ["mann", "frau", "männer", "frauen", "männlich", "weiblich"],
    "orientation, de": ["schwul", "lesbisch", "bisexuell", "heterosexuell"],
    "religion, de": ["christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"],
    "origin, de": ["afrikanisch", "amerikanisch", "asiatisch", "europäisch", "arabisch", "türkisch", "polnisch"],
    "gender, fr": ["homme", "femme", "hommes", "femmes", "masculin", "féminine"],
    "orientation, fr": ["lesbienne", "bisexuel", "hétérosexuel", "homosexuel"],
    "religion, fr": ["chrétien", "musulman", "juif", "hindou", "bouddhiste", "catholique"],
    "origin, fr": ["africain", "américain", "asiatique", "européen", "arabe", "turc", "polonais"],
    "gender, es": ["hombre", "mujer", "hombres", "mujeres", "masculino", "femenino"],
    "orientation, es": ["lesbiana", "bisexual", "heterosexual", "homosexual"],
    "religion, es": ["cristiano", "musulmán", "judío", "hindú", "budista", "católico"],
    "origin, es": ["africano", "americano", "asiático", "europeo", "árabe", "turco", "polaco"],
}
#: At most so many labelled rows of each class are learned from: those of the smallest hashed id.
SAMPLE_PER_CLASS = 6000
#: At most so many words have a weight: those whose presence tells most about the label.
WORDS = 3000

#: Least chi-squared of a word with a weight: about what chance gives the luckiest of a large vocabulary.
TELLING = 24.0

STEMS = (4, 6, 8)

_SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def _swaps() -> dict[bytes, list[bytes]]:
    """Each term, and its form with an s, and what it is swapped for: the others of its kinds in the same form."""
    out: dict[bytes, list[bytes]] = {}
    for terms in IDENTITY_TERMS.values():
        for t in terms:
            for end in ("", "s"):
                out.setdefault((t + end).encode(), []).extend((x + end).encode() for x in terms if x != t)
    return {t: list(dict.fromkeys(others)) for t, others in out.items()}


_SWAPS = _swaps()


def plain_words(text: bytes) -> set[bytes]:
    """A text's words, A-Z lower-cased: runs of ASCII letters, digits and non-ASCII bytes."""
    return set(text.lower().translate(_SPACED).split())


def with_beginnings(words: set[bytes]) -> set[bytes]:
    """``words`` and their beginnings of 4, 6 and 8 bytes, marked ``*``, which cover inflected and compound forms."""
    return words.union(*({w[:k] + b"*" for w in words if len(w) > k} for k in STEMS))


def words_of(text: bytes) -> set[bytes]:
    """What a text is scored by: its words and their beginnings."""
    return with_beginnings(plain_words(text))


def swaps_of(words: set[bytes]) -> Iterator[set[bytes]]:
    """What a text of the plain ``words`` is scored by with each identity term exchanged for another of its kind, in turn
    for all others; nothing if there is no term."""
    for turn in range(max((len(_SWAPS[w]) for w in words & _SWAPS.keys()), default=0)):
        yield with_beginnings({_SWAPS[w][turn % len(_SWAPS[w])] if w in _SWAPS else w for w in words})


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: bytes) -> float:
        w = self.weights
        z = self.bias + sum(w[x] for x in w.keys() & words_of(text))
        return float(1 / (1 + np.exp(-z)))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of the rows to learn from, and how many labelled ids each class has.

    Only ids whose crc32 as text is not 0 modulo 5 count; null, other and contradicting labels are left out. Of several
    texts of an id the least is learned from.
    """
    one = (
        labels.where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .where("toxic = most")
        .where(crc_remainder(F.col("doc_id"), 5) != 0)
        .select("doc_id", "toxic")
    )
    pick = lambda c: one.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).union(pick(1))
    sizes = {r.toxic: r["count"] for r in one.groupBy("toxic").count().collect()}
    found = documents(docs).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic"), sizes


def telling_words(sample: DataFrame, most: int) -> list[bytes]:
    """The words whose presence is least independent of the label (chi-squared), and, if a term is seen, all identity
    terms with their beginnings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
                seen[y].update(words_of(t))
        words = list(seen[0].keys() | seen[1].keys())
        cols = [pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)]
        yield pa.RecordBatch.from_arrays(cols, ["word", "n0", "n1"])

    n0, n1 = (sample.where(F.col("toxic") == c).count() for c in (0, 1))
    counts = sample.select("text", "toxic").mapInArrow(count, "word binary, n0 long, n1 long")
    counts = counts.groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 >= 3")
    e = (F.col("n0") + F.col("n1")) / F.lit(max(n0 + n1, 1))
    chi = (F.col("n1") - e * n1) ** 2 / (e * max(n1, 1)) + (F.col("n0") - e * n0) ** 2 / (e * max(n0, 1))
    told = counts.withColumn("chi", chi).where(F.col("chi") >= TELLING)
    best = [bytes(r.word) for r in told.orderBy(F.col("chi").desc(), "word").limit(most).collect()]
    terms = counts.where(F.col("word").isin([bytearray(t) for t in _SWAPS])).select("word").collect()
    return sorted({*best, *(with_beginnings(set(_SWAPS)) if terms else ())})


def _fit(rows: list, n_words: int, sizes: dict[int, int], fairness: float, decay: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps; rows are (label, words, changes).

    A change is what a swap takes (word + 1) and brings (-word - 1); words of both versions cancel out."""

    def packed(lists: list) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.array([i for x in lists for i in x], dtype=np.int64)
        return flat, np.repeat(np.arange(len(lists)), n)

    y = np.array([r[0] for r in rows], dtype=float)
    at, row = packed([r[1] for r in rows])
    pairs = [change for r in rows for change in r[2]]
    word, pair = packed(pairs)
    sign, word = np.sign(word).astype(float), np.abs(word) - 1
    share = np.array([sizes.get(int(v), 1) / max((y == v).sum(), 1) for v in y])
    share /= share.mean()
    w, momentum = np.zeros(n_words + 1), np.zeros(n_words + 1)
    second = np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[at], len(y)) + w[-1]
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.r_[np.bincount(at, g[row], n_words), g.sum()]
        grad[:-1] += decay * w[:-1] / len(y)
        if len(pairs):  # the penalty: squared change of the score under a swap
            change = np.bincount(pair, sign * w[word], len(pairs))
            grad[:-1] += 2 * fairness / len(pairs) * np.bincount(word, sign * change[pair], n_words)
        momentum = 0.9 * momentum + 0.1 * grad
        second = 0.99 * second + 0.01 * grad * grad
        w -= 0.1 * (momentum / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9) * (1 - step / (steps + 1))
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, words: int = WORDS, fairness: float = 4.0, decay: float = 0.5, steps: int = 400) -> Model:
    """A model of ``labels`` (doc_id, toxic) over the texts of ``docs``.

    It learns from at most ``per_class`` rows of each class, weighted so that classes count as in all labelled ids. Where
    ``docs`` has labelled rows of one class only, every score is 0.01 or 0.99; where it has none, one half.
    """
    bounded_batches(docs.sparkSession)
    sample, sizes = labelled_sample(docs, labels, per_class)
    sample = stored(sample, "labelled-sample")
    seen = sorted(r.toxic for r in sample.select("toxic").distinct().collect())
    if len(seen) < 2:
        rate = {(): 0.5, (0,): 0.01, (1,): 0.99}[tuple(seen)]
        return Model({}, float(np.log(rate / (1 - rate))))
    vocabulary = telling_words(sample, words)
    index = {w: i for i, w in enumerate(vocabulary)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, changes = [], []
            for t in b.column(0).cast(pa.binary()).to_pylist():
                plain = plain_words(t)
                found = index.keys() & with_beginnings(plain)
                own.append(sorted(index[w] for w in found))
                swaps = (index.keys() & s for s in swaps_of(plain))
                changes.append([sorted([index[w] + 1 for w in found - s] + [-index[w] - 1 for w in s - found]) for s in swaps])
            kinds = [pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
            cols = [b.column(1), b.column(2), *(pa.array(x, k) for x, k in zip((own, changes), kinds))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "toxic", "own", "changes"])

    kinds = dict(sample.dtypes)
    rows = sample.select("text", "doc_id", "toxic").mapInArrow(
        features, f"doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, own array<int>, changes array<array<int>>"
    )
    rows = [(r.toxic, r.own, r.changes) for r in sorted(rows.collect(), key=lambda r: r.doc_id)]  # the bounded sample
    discard(sample)
    weights, bias = _fit(rows, len(vocabulary), sizes, fairness, decay, steps)
    return Model({w: float(x) for w, x in zip(vocabulary, weights) if x}, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; null texts are empty, and every text has a score.

    Only the text is an input, whole however long. Repeated rows stay repeated; other columns are not read; an empty table
    gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.score(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    d = documents(docs)
    return d.mapInArrow(run, f"doc_id {dict(d.dtypes)['doc_id']}, score double")


def keep_clean(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """The rows of ``docs`` with a score under 0.5, with ``columns``, text (maybe null) among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            yield b.filter(pa.array([model.score(t or b"") < 0.5 for t in texts], pa.bool_()))

    bounded_batches(docs.sparkSession)
    d = docs.select(*columns)
    return d.mapInArrow(run, d.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
