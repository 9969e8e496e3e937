"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

A text is its letter 1- to 3-grams within words, hashed to ``DIM`` places, as shares of all its grams. A decision is linear in
these shares, so a text of any length is scored by sums over its grams. Machines are fitted on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_remainder, documents, table

#: Families of languages by their ISO 639-1 codes. A language of none is a family by itself.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms su tl",
    "bantu": "rw sn sw xh zu",
}
#: At most so many documents of each language are learned from, and so many languages, the most frequent.
SAMPLE_PER_LANGUAGE, LANGUAGES = 1000, 60
#: Places that grams are hashed to. Texts are read in pieces of so many characters, which overlap by two.
DIM, PIECE = 1 << 13, 1 << 19
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000))
    return _letters[0]


def grams(texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place of a text in ``texts``, place of a gram in DIM) of all 1-, 2- and 3-grams. Letters are lowered; whatever else
    parts words, whose beginnings and ends count as a letter in 2- and 3-grams."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(low) + 1, dtype=np.int32), [1, *(len(t) + 1 for t in low)]) - 1
    letter = _is_letter()[codes]
    keep = np.r_[True, letter[1:] | letter[:-1]]
    c, doc = np.where(letter, codes, 0)[keep].astype(np.uint32), doc[keep]
    shift = np.uint32(32 - DIM.bit_length() + 1)
    place = lambda x: ((x ^ x >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> shift).astype(np.uint16)
    one = c != 0
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77) + np.uint32(1)
    some = one[:-1] | one[1:]
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F) + np.uint32(2)
    at = np.where(one[:-1], doc[:-1], doc[1:])
    return [(doc[one], place(c[one] * np.uint32(0x165667B1))), (at[some], place(two[some])), (doc[1:-1][one[1:-1]], place(three[one[1:-1]]))]


def pieces(text: str) -> list[str]:
    return [text[max(a - 2, 0) : a + PIECE] for a in range(0, max(len(text), 1), PIECE)]


def _batches(texts: Sequence[str], most: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """Places and pieces of texts, of about ``most`` characters at a time."""
    places, held, n = [], [], 0
    for i, t in enumerate(texts):
        for p in pieces(t):
            places.append(i)
            held.append(p)
            n += len(p)
            if n >= most:
                yield places, held
                places, held, n = [], [], 0
    if held:
        yield places, held


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's grams and their shares."""
    count = np.zeros(DIM)
    for _, some in _batches([text]):
        for _, h in grams(some):
            count += np.bincount(h, minlength=DIM)
    at = np.flatnonzero(count)
    return at, count[at] / max(count.sum(), 1)


def linear_svm(rows: Sequence[tuple[np.ndarray, np.ndarray]], positive: np.ndarray, cost: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (DIM and a constant) of a linear support vector machine with squared hinge loss, by dual coordinate descent.
    Both classes count alike, whatever their sizes."""
    y = np.where(positive, 1.0, -1.0)
    per = np.where(positive, len(y) / (2 * max(positive.sum(), 1)), len(y) / (2 * max((~positive).sum(), 1)))
    loose = 1 / (2 * cost * per)
    w, alpha = np.zeros(DIM + 1), np.zeros(len(y))
    norm = np.array([float(v @ v) + 1 for _, v in rows]) + loose
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)).tolist():
            at, v = rows[i]
            slope = y[i] * (w[at] @ v + w[DIM]) - 1 + loose[i] * alpha[i]
            new = max(alpha[i] - slope / norm[i], 0.0)
            step = (new - alpha[i]) * y[i]
            if step:
                worst = max(worst, abs(slope))
                w[at] += step * v
                w[DIM] += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w


@dataclass
class Level:
    """One-versus-one machines between ``classes``: row k of ``weights`` is for ``pairs[k]``, positive for its first."""

    classes: list[str]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.empty((0, DIM + 1)))

    @staticmethod
    def learned(rows: list[tuple[np.ndarray, np.ndarray]], of: Sequence[str], scale: np.ndarray) -> Level:
        classes, of = sorted(set(of)), np.array(of)
        scaled = [(at, v * scale[at]) for at, v in rows]
        pairs, weights = list(combinations(range(len(classes)), 2)), []
        for i, j in pairs:
            at = np.flatnonzero((of == classes[i]) | (of == classes[j])).tolist()
            w = linear_svm([scaled[k] for k in at], of[at] == classes[i])
            weights.append(np.r_[w[:DIM] * scale, w[DIM]])
        return Level(classes, pairs, np.array(weights).reshape(len(pairs), DIM + 1))

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each row of ``margins`` (a column for each pair), and its least margin over another: most votes win,
        ties go by the sum of margins."""
        n, k = len(margins), len(self.classes)
        votes, total, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for m, (i, j) in zip(margins.T, self.pairs):
            for c, x in ((i, m), (j, -m)):
                votes[:, c] += x > 0 if c == i else x >= 0
                total[:, c] += x
                least[:, c] = np.minimum(least[:, c], x)
        best = np.lexsort((-total, -votes), axis=1)[:, 0] if k else np.zeros(n, dtype=int)
        return best, least[np.arange(n), best]


@dataclass
class Model:
    """The families' machines, and those of each family's languages."""

    families: Level
    languages: dict[str, Level]

    def predict(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score from 0 to 1: 1 / (1 + exp(-2 m)) of its least margin m in both steps."""
        n = len(texts)
        if not self.families.classes:
            return [UNKNOWN] * n, np.zeros(n)
        levels = [self.families, *self.languages.values()]
        ends = np.cumsum([0, *(len(x.pairs) for x in levels)])
        total, sums = np.zeros(n), np.zeros((n, ends[-1]))
        family, margin = np.zeros(n, dtype=int), np.full(n, np.inf)
        held = list(_batches(texts))
        found = [(np.array(places), grams(some)) for places, some in held] if len(held) == 1 else None
        each = lambda: found or ((np.array(p), grams(s)) for p, s in held)
        for places, some in each():
            for doc, h in some:
                doc = places[doc]
                total += np.bincount(doc, minlength=n)
                for k, w in enumerate(self.families.weights):
                    sums[:, k] += np.bincount(doc, weights=w[h], minlength=n)
        per = np.maximum(total, 1)[:, None]
        family, margin = self.families.decide(sums[:, : ends[1]] / per + self.families.weights[:, DIM])
        inner = [self.languages[c] for c in self.families.classes]
        start = [ends[1 + list(self.languages).index(c)] for c in self.families.classes]
        for places, some in each():
            for doc, h in some:
                doc = places[doc]
                of = family[doc]
                for f, level in enumerate(inner):
                    if level.pairs and (mine := of == f).any():
                        d, x = doc[mine], h[mine]
                        for k, w in enumerate(level.weights):
                            sums[:, start[f] + k] += np.bincount(d, weights=w[x], minlength=n)
        names = [UNKNOWN] * n
        for f, level in enumerate(inner):
            at = np.flatnonzero(family == f)
            best, least = level.decide(sums[at, start[f] : start[f] + len(level.pairs)] / per[at] + level.weights[:, DIM])
            margin[at] = np.minimum(margin[at], least)
            for i, b in zip(at.tolist(), best.tolist()):
                names[i] = level.classes[b]
        return names, 1 / (1 + np.exp(-2 * np.clip(margin, -50, 50)))


def family_of(language: str, families: Mapping[str, str]) -> str:
    code = language.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in families.items() if code in codes.split()), language)


def has_letter(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def train(docs: DataFrame, families: Mapping[str, str] = FAMILIES, per_language: int = SAMPLE_PER_LANGUAGE, most: int = LANGUAGES) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text, lang) with a language and a letter whose crc32(doc_id as text) mod 5 is
    not 0: of each of the ``most`` most frequent languages the ``per_language`` rows of the smallest hashes of id and text
    (of those under a bound that holds about twice as many).
    Equal rows count once. What reaches the driver are these rows' shares of grams, at most DIM numbers each."""
    usable = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text")) & (crc_remainder(F.col("doc_id"), 5) != 0))
    marked = usable.select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    known = marked.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n")).orderBy(F.desc("n"), "lang").limit(most)
    # Hashes under this hold about twice as many rows as are taken: few enough to be ranked.
    under = (F.least(F.lit(2.0 * per_language) / F.col("n"), F.lit(1.0)) * 2.0**64 - 2.0**63).alias("under")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    hashes = marked.join(F.broadcast(known.select("lang", under)), "lang").where("h <= under").select("lang", "h").distinct()
    chosen = hashes.withColumn("k", order).where(F.col("k") <= per_language).select("lang", "h")  # at most most x per_language
    sample = marked.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shares(t) for t in b.column(2).to_pylist()]
            cols = [pa.array([x.astype("<u2").tobytes() for x, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["lang", "h", "at", "share"])

    bounded_batches(docs.sparkSession)
    rows = sorted(sample.mapInArrow(run, "lang string, h long, at binary, share binary").collect(), key=lambda r: (r.lang, r.h))
    data = [(np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.share, "<f4").astype(float)) for r in rows]
    mean = np.zeros(DIM)
    for at, v in data:
        mean[at] += v / len(data)
    scale = 1 / np.sqrt(mean + 1 / DIM)
    of = [family_of(r.lang, families) for r in rows]
    levels = {}
    for f in sorted(set(of)):
        at = [i for i, x in enumerate(of) if x == f]
        levels[f] = Level.learned([data[i] for i in at], [rows[i].lang for i in at], scale)
    return Model(Level.learned(data, of, scale), levels)


def identify(docs: DataFrame, model: Model, *more: str) -> DataFrame:
    """doc_id, lang_pred, score and ``more`` of each row of ``docs`` (doc_id, text); other columns are not read.

    Whole texts are read. A text that is null or has no letter is ``und`` with a score of 0, and so is every text where no
    language was learned; where one was, its score is 1. Rows stay as they are, repeated ones too; a row's result comes from
    it alone, so nothing is shuffled. Every task has a copy of the machines, at most LANGUAGES x LANGUAGES of DIM numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = np.full(b.num_rows, UNKNOWN, dtype=object)
            scores = np.zeros(b.num_rows)
            at = np.flatnonzero(b.column(2).to_numpy(False))
            if len(at):
                names[at], scores[at] = model.predict(b.column(1).take(pa.array(at)).to_pylist())
            cols = [b.column(0), pa.array(names, pa.string()), pa.array(scores), *b.columns[3:]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "lang_pred", "score", *more])

    bounded_batches(docs.sparkSession)
    d = documents(docs, *more)
    d = d.select("doc_id", "text", has_letter(F.col("text")).alias("_letter"), *more)
    kinds = [d.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), *(d.schema[c] for c in more)]
    return d.mapInArrow(run, T.StructType(kinds))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
