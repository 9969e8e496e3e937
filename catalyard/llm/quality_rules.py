"""Quality rules: text statistics in Spark expressions and learned decision lists.

Sequential covering grows and prunes conjunctions of thresholds on labelled statistics and emits them as an ordered
conditional expression. DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, WORD_GAP, WORD_GAP_CHARS, crc_remainder, documents, table

SYMBOLS = "#*$%&|<>"
#: Statistics that conditions may test.
FEATURES = [
    "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "shout_share",
    "distinct_share", "line_words", "n_words",
]
#: At most so many labelled rows of each class are learned from: those of the smallest hashed id.
SAMPLE_PER_CLASS = 4000


def _length_of(c: Column, chars: str) -> Column:
    """How many of ``chars`` the text holds."""
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("long")


def _fixed(df: DataFrame, keep: Sequence[str], cols: Sequence[Column]) -> DataFrame:
    """``keep`` and ``cols``, each computed once: later filters and projections aren't merged into a generator."""
    return df.select(*keep, F.inline(F.array(F.struct(*cols))))


def statistics(docs: DataFrame, *more: str, window: int = 5, features: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """doc_id, ``more``, the base columns (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and ``features``.

    Every whole text counts (null: none); a row's statistics come from that row alone, so nothing is shuffled. Words
    in repeated windows are found by hashing each window in place; the sort that locates them runs only for texts
    whose window hashes repeat.
    """
    text = F.coalesce("text", F.lit(""))
    core = F.trim(text, F.lit(WORD_GAP_CHARS))
    nothing = F.array().cast("array<string>")
    a = docs.select("doc_id", *more, text.alias("text"), core.alias("_core"))
    split = F.when(F.col("_core") == "", nothing).otherwise(F.split("_core", WORD_GAP))
    a = _fixed(a, ["doc_id", *more, "text"], [split.alias("words")])
    n = F.size("words")
    hashes = F.transform(
        F.slice("words", F.lit(1), F.greatest(n - (window - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get("words", i + k) for k in range(1, window))),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WORD_GAP_CHARS, "")) > 0)
    first = [
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", WORD_GAP_CHARS, "")).cast("long").alias("word_chars"),
        _length_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        lines.alias("_lines"),
        hashes.alias("_hashes"),
    ]
    own = {  # what only one feature needs
        "upper_share": _length_of(F.col("text"), UPPER).alias("_upper"),
        "digit_share": _length_of(F.col("text"), "0123456789").alias("_digits"),
        "shout_share": _length_of(F.col("text"), "!?").alias("_shouts"),
        "distinct_share": F.size(F.array_distinct("words")).alias("_distinct"),
    }
    extra = {"upper_share": "_upper", "digit_share": "_digits", "shout_share": "_shouts", "distinct_share": "_distinct"}
    first += [c for f, c in own.items() if f in features]
    a = _fixed(a, ["doc_id", *more], first)
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    at = F.when(repeats, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    n_lines = F.size("_lines")
    dups = (n_lines - F.size(F.array_distinct("_lines"))).cast("long")
    carried = ["n_words", "word_chars", "n_symbols", *(c for f, c in extra.items() if f in features)]
    a = _fixed(a, ["doc_id", *more, *carried], [at.alias("_at"), n_lines.alias("_n_lines"), dups.alias("n_dup_lines")])
    same = lambda x, j: F.coalesce(F.get("_at", j).h == x.h, F.lit(False))
    found = F.array_sort(
        F.transform(F.filter("_at", lambda x, j: ((j > 0) & same(x, j - 1)) | same(x, j + 1)), lambda x: x.i)
    )
    covered = F.aggregate(
        found,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda s, i: F.struct((s.n + i + window - F.greatest(i, s.end)).alias("n"), (i + window).alias("end")),
        lambda s: s.n.cast("long"),
    )
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), F.lit(0.0))
    a = _fixed(
        a,
        ["doc_id", *more, *carried, "_n_lines", "n_dup_lines"],
        [F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")],
    )
    shares = {
        "word_length": ("word_chars", "n_words"),
        "symbol_share": ("n_symbols", "n_words"),
        "dup_line_share": ("n_dup_lines", "_n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
        "upper_share": ("_upper", "word_chars"),
        "digit_share": ("_digits", "word_chars"),
        "shout_share": ("_shouts", "n_words"),
        "distinct_share": ("_distinct", "n_words"),
        "line_words": ("n_words", "_n_lines"),
    }
    base = ["doc_id", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return a.select(*base, *(share(*shares[f]).alias(f) for f in features if f in shares))


Condition = tuple[str, str, float]
Rule = list[Condition]


class _Column:
    """A feature's values over some rows, sorted, and how many bad rows lie at or below each place."""

    def __init__(self, values: np.ndarray, bad: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, self.bad = values[order], np.r_[0, np.cumsum(bad[order])]

    def covered(self, op: str, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and bad rows, that ``op`` a cut lets in."""
        if op == "<=":
            n = np.searchsorted(self.values, cuts, "right")
            return n, self.bad[n]
        n = np.searchsorted(self.values, cuts, "left")
        return len(self.values) - n, self.bad[-1] - self.bad[n]


def _best(grow: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], conditions: Rule) -> Condition | None:
    """The condition with the largest gain of information on bad rows (FOIL's measure), the first of equals."""
    base = np.log2(bad.mean()) if bad.any() else 0.0
    best, gain = None, 1e-9
    for f, c in cuts.items():
        column = _Column(grow[f], bad)
        found = {}
        for op in (">=", "<="):
            every, hit = column.covered(op, c)
            with np.errstate(divide="ignore", invalid="ignore"):
                found[op] = np.where(hit > 0, hit * (np.log2(hit / every) - base), -1.0)
        for i, cut in enumerate(c.tolist()):
            for op in (">=", "<="):
                if found[op][i] > gain and (f, op, cut) not in conditions:
                    best, gain = (f, op, cut), float(found[op][i])
    return best


def learn_rules(rows: list, features: Sequence[str], max_rules: int = 8, max_terms: int = 4, precision: float = 0.97, steps: int = 24) -> list[Rule]:
    """Ordered conjunctions that mark bad rows, by sequential covering over ``rows`` (features and ``bad`` 0/1).

    Two thirds of the rows grow a rule term by term; the rest prune it by dropping final terms while that does not
    lower (bad - good) / covered. A rule is kept if it is right for ``precision`` of what it covers in all rows left
    and covers at least 3 bad ones; what it covers is then taken out. The search ends at the first rule that fails
    or when no bad row is left. No rows, or rows of one class, give no rules.
    """
    left = {f: np.array([r[f] for r in rows], dtype=float) for f in features}
    bad, rules = np.array([r["bad"] for r in rows], dtype=bool), []

    def holds(data: dict[str, np.ndarray], conditions: Rule) -> np.ndarray:
        return reduce(lambda x, y: x & y, (data[f] >= t if op == ">=" else data[f] <= t for f, op, t in conditions))

    for _ in range(max_rules):
        if bad.sum() < 3:
            break
        growing = np.arange(len(bad)) % 3 > 0
        grow, grown = {f: x[growing] for f, x in left.items()}, bad[growing]
        prune, pruned = {f: x[~growing] for f, x in left.items()}, bad[~growing]
        cuts = {}
        for f in features:
            values = np.sort(grow[f][grown])
            cuts[f] = np.unique(values[(len(values) - 1) * np.arange(steps + 1) // steps]) if len(values) else values
        conditions: Rule = []
        while len(conditions) < max_terms and not grown.all():
            best = _best(grow, grown, cuts, conditions)
            if best is None:
                break
            conditions.append(best)
            inside = holds(grow, [best])
            grow, grown = {f: x[inside] for f, x in grow.items()}, grown[inside]

        def worth(c: Rule, prune: dict = prune, pruned: np.ndarray = pruned) -> float:
            hit = pruned[holds(prune, c)]
            return float((2 * hit.sum() - len(hit)) / len(hit)) if len(hit) else -1.0

        while len(conditions) > 1 and worth(conditions[:-1]) >= worth(conditions):
            conditions.pop()
        covered = holds(left, conditions) if conditions else np.zeros(len(bad), dtype=bool)
        hit = bad[covered]
        if hit.sum() < 3 or hit.sum() < precision * len(hit):
            break
        rules.append(conditions)
        left, bad = {f: x[~covered] for f, x in left.items()}, bad[~covered]
    return rules


def rule_number(rules: list[Rule]) -> Column:
    """The conditional expression: the number (from 1) of the first rule that holds, else null."""

    def test(c: Condition) -> Column:
        return F.col(c[0]) >= c[2] if c[1] == ">=" else F.col(c[0]) <= c[2]

    out = F.lit(None).cast("int")
    for i, r in reversed(list(enumerate(rules, 1))):
        out = F.when(reduce(lambda x, y: x & y, map(test, r)), F.lit(i)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> list:
    """Statistics of at most ``per_class`` labelled rows of each quality, chosen by hashed id from rows whose
    crc32(doc_id as text) mod 5 is not 0. Null or contradicting labels are left out; of several texts of an id the least
    is learned from."""
    one = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_q"))
        .where("quality = _q")
        .where(crc_remainder(F.col("doc_id"), 5) != 0)
        .select("doc_id", "quality")
    )
    pick = lambda q: one.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    chosen = pick(0).union(pick(1))
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    stats = statistics(found, "quality").where(~base_failed())
    rows = stats.select(F.xxhash64("doc_id").alias("_h"), "doc_id", *FEATURES, (1 - F.col("quality")).alias("bad")).collect()
    return sorted(rows, key=lambda r: (r["_h"], r["doc_id"]))  # the bounded sample


def learned(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> list[Rule]:
    """A decision list for bad documents from ``labels`` (doc_id, quality)."""
    return learn_rules(labelled_sample(docs, labels, per_class), FEATURES)


def judge_quality(docs: DataFrame, rules: list[Rule], *more: str) -> DataFrame:
    """The base statistics with base_failed, rule (the number of the first rule that holds, else null) and kept; other
    statistics are computed only where a rule tests them.

    Rows stay as they are: repeated ids stay repeated, a null or empty text fails the base test. Empty tables give
    empty results. A document is kept unless the base test or a rule rejects it.
    """
    tested = [f for f in FEATURES if any(f == c[0] for r in rules for c in r)]
    out = statistics(docs, *more, features=tested).withColumn("base_failed", base_failed()).withColumn("rule", rule_number(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(table(spark, sf_dir, "documents"))
    rules = learned(docs, table(spark, sf_dir, "labels"))
    return judge_quality(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )
