"""Mixing sources to target weights by cube-method balanced sampling.

Every document is taken ``target / source size`` times on average: the whole part of that surely, the fraction as an
inclusion probability. A flight moves the fractions through the null-space of the constraints (words and documents of
the source), so that both totals stay what they are, until a handful of fractions is left to land.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Documents that one flight handles; what it leaves (2 at most) goes to the next level.
BLOCK = 4000
#: Fractions that are kept for a source's landing.
LANDING = 14
_NEAR = 1e-9


def word_counts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, size (words of the whole text; null: 0) and ``more`` for each row, in Spark expressions."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", words.cast("long").alias("size"), *more)


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, n_docs, source_size, target) for each source of ``sizes`` (source, size); a null source is one.

    Sources in code point order (null last) weigh ``weights``, repeating. They split ``share`` of all sizes by weight; a
    target stops at ``most`` times its source's size and the excess goes to the others by weight, until none is above.
    The level at which all is given out is the root of a concave function of straight pieces; each round is a Newton step
    to it, so few rounds do, however many sources there are.
    """
    found = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    # Ranks in order, without a single task: within range partitions, then from the partitions' counts.
    ordered = found.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33)
    counts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    before, total = {}, 0
    for r in sorted(counts):
        before[r.part], total = total, total + r.n
    pairs = [F.lit(x) for kv in before.items() for x in kv] or [F.lit(0), F.lit(0)]
    rank = F.create_map(*pairs)[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.array(*map(F.lit, map(float, weights)))[(rank % len(weights)).cast("int")]
    weighed = ordered.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    whole = weighed.agg(F.sum("source_size").alias("s")).first().s or 0
    level, capped = 0.0, -1  # words for each unit of weight; sources at their cap
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        r = weighed.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("free"),
            F.coalesce(F.sum(full.cast("long")), F.lit(0)).alias("n"),
        ).first()
        if r.n == capped or not r.free:
            break
        capped, level = r.n, (share * whole - r.held) / r.free
    target = F.least("cap", F.lit(level) * F.col("weight")) if r.free else F.col("cap")
    return weighed.select("source", "n_docs", "source_size", target.cast("double").alias("target"))


def flight(sizes: Sequence[float], chances: list[float], rng: random.Random) -> list[float]:
    """``chances`` moved so that their sum and their sum weighted by ``sizes`` stay, until at most 2 are fractions."""
    out, held = list(chances), []
    for i in range(len(out)):
        if out[i] <= _NEAR or out[i] >= 1 - _NEAR:
            out[i] = float(round(out[i]))
            continue
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, d in zip(held, u):
            if d > 0:
                up, down = min(up, (1 - out[k]) / d), min(down, out[k] / d)
            elif d < 0:
                up, down = min(up, out[k] / -d), min(down, (1 - out[k]) / -d)
        step = up if rng.random() * (up + down) < down else -down
        for k, d in zip(held, u):
            out[k] += step * d
        for k in held:
            if out[k] <= _NEAR or out[k] >= 1 - _NEAR:
                out[k] = float(round(out[k]))
        held = [k for k in held if 0 < out[k] < 1]
    return out


def landing(sizes: Sequence[float], chances: list[float]) -> list[float]:
    """The fractions left (``LANDING`` and two at most), each set to 0 or 1 so that first the words and then the
    documents come nearest to their expectation."""
    left = [i for i, p in enumerate(chances) if 0 < p < 1]
    out = list(chances)
    if left:
        size, chance = np.array([sizes[i] for i in left]), np.array([chances[i] for i in left])
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
        off = ways - chance
        cost = np.abs((off * size).sum(axis=1)) + 0.05 * size.mean() * np.abs(off.sum(axis=1))
        for i, x in zip(left, ways[int(cost.argmin())]):
            out[i] = float(x)
    return out


def settled(sizes: Sequence[float], chances: list[float], rng: random.Random) -> list[float]:
    """A source's last flight and landing. Up to ``LANDING`` fractions of spread sizes stay out of the flight, for the
    landing to balance what the flight can't place, such as one very long document."""
    fractions = sorted((sizes[i], i) for i, p in enumerate(chances) if 0 < p < 1)
    n = min(LANDING, len(fractions))
    kept = {fractions[k * len(fractions) // n][1] for k in range(n)} if n else set()
    flying = [i for i in range(len(chances)) if i not in kept]
    moved = flight([sizes[i] for i in flying], [chances[i] for i in flying], rng)
    out = list(chances)
    for i, p in zip(flying, moved):
        out[i] = p
    return landing(sizes, out)


def _blocks(n_docs: int, block: int, level: int) -> int:
    """How many blocks a source of ``n_docs`` is dealt to: at later levels as many fewer as flights leave fractions."""
    return max(1, -(-n_docs // (block * (block // 2) ** level)))


def _flown(key: str, seed: int, level: int, block: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One block's flight; where a source is one block, its landing too, whatever other sources need."""

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["size"], pdf["hashed"]))].reset_index(drop=True)
        first = pdf.iloc[0]
        rng = random.Random(f"{seed}/{level}/{first['no_source']}/{first['named']}/{first['block']}")
        sizes = pdf["size"].astype(float).tolist()
        order = list(range(len(pdf)))
        rng.shuffle(order)
        chances = pdf["chance"].tolist()
        go = settled if _blocks(int(first["n_docs"]), block, level) == 1 else flight
        moved = go([sizes[i] for i in order], [chances[i] for i in order], rng)
        out = [0.0] * len(pdf)
        for i, p in zip(order, moved):
            out[i] = p
        pdf["chance"] = out
        return pdf.drop(columns="block")

    return fly


def mix(
    docs: DataFrame, key: str, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7, block: int = BLOCK, more: Sequence[str] = ()
) -> DataFrame:
    """(key, size, source, source_size, target, copies) and ``more`` for every row of ``docs`` (key, size, source).

    Levels of flights run over blocks of about ``block`` rows of one source, dealt by hashed key; each leaves at most two
    fractions, which the next level gathers, until a source's fit one block; those land. Large sources are spread over
    many blocks, and nothing but a block is held in memory. What a source gets doesn't depend on the others but for its
    target. The same rows and seed give the same result; rows with equal keys and sizes are interchangeable. A null source
    is a source of its own, a source without words has no copies, very long texts are sizes like any other, other columns
    are not read, and an empty table gives an empty result.
    """
    t = stored(targets(docs.select("source", "size"), weights, share, most), "targets")
    # Null-safe join by a pair of columns that are never null.
    named = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("named")]
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    rows = docs.select(key, "size", *more, F.xxhash64(key).alias("hashed"), *named).join(
        t.select("n_docs", "source_size", "target", rate.alias("rate"), *named), ["no_source", "named"]
    )
    whole = F.floor(F.col("rate") + _NEAR)
    chance = F.when(F.col("rate") - whole > _NEAR, F.col("rate") - whole).otherwise(0.0)
    state = rows.withColumn("base", whole.cast("long")).withColumn("chance", chance).drop("rate")
    most_docs = t.agg(F.max("n_docs").alias("n")).first().n or 0
    level, done = 0, None
    schema = state.schema
    while True:
        n = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(block * (block // 2) ** level))).cast("int")
        dealt = state.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + level), "hashed", "size"), n).cast("int"))
        flown = stored(dealt.groupBy("no_source", "named", "block").applyInPandas(_flown(key, seed, level, block), schema), "flight")
        fixed = flown.where("chance = 0 or chance = 1")
        done = fixed if done is None else done.unionByName(fixed)
        if _blocks(most_docs, block, level) == 1:
            break
        state, level = flown.where("chance > 0 and chance < 1"), level + 1
    return done.select(
        key,
        "size",
        F.when(~F.col("no_source"), F.col("named")).alias("source"),
        "source_size",
        "target",
        (F.col("base") + F.col("chance").cast("long")).alias("copies"),
        *more,
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stored(word_counts(table(spark, sf_dir, "documents"), "source"), "sizes")
    return mix(sized, "doc_id").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )
