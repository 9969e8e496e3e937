"""Merges and renames of many brands at once, from a table of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import blank, strip_code_prefix, text
from ..sources.scratch import written
from .maintain import MERGE_FIELDS, fold_prefixed, joined_notes


def _jumped(steps: DataFrame) -> DataFrame:
    """``steps`` (node, next, path) with each path up to its end, and ``next`` where there is none: a cycle.

    Pointers jump to where their targets point, so a path of n steps is whole after log2 n rounds."""
    left, rounds = steps, max(steps.count(), 1).bit_length() + 1
    for _ in range(rounds):
        if not left.where("next is not null").limit(1).count():
            break
        to = left.select(F.col("node").alias("_n"), F.col("next").alias("_next"), F.col("path").alias("_path"))
        joined = left.join(to, F.col("next") == F.col("_n"), "left")
        whole = F.concat("path", F.coalesce("_path", F.array().cast(dict(steps.dtypes)["path"])))
        left = written(joined.select("node", F.col("_next").alias("next"), whole.alias("path")), "jumps")
    return left


def in_order(pairs: DataFrame) -> DataFrame:
    """``pairs`` (source, target) with ``at``, their turns: what comes to a brand before what leaves it.

    Chains of pairs are followed to their ends; a source has one target. ValueError where pairs go round in a circle, or from
    a brand to itself, or a source has two targets.
    """
    pairs = pairs.select("source", "target").distinct()
    twice = [r.source for r in pairs.groupBy("source").count().where("count > 1").orderBy("source").limit(5).collect()]
    if twice:
        raise ValueError(f"several targets: {twice}")
    onward = pairs.select(F.col("source").alias("_s"))
    steps = pairs.join(onward, F.col("target") == F.col("_s"), "left")
    steps = steps.select(F.col("source").alias("node"), F.col("_s").alias("next"), F.array(F.col("target")).alias("path"))
    ends = _jumped(steps)
    round_ = [r.node for r in ends.where("next is not null").orderBy("node").limit(5).collect()]
    if round_:
        raise ValueError(f"pairs that lead back: {round_}")
    turn = F.row_number().over(Window.orderBy(F.desc(F.size("path")), "node"))  # a row for each pair
    return pairs.join(ends.select(F.col("node").alias("source"), turn.alias("at")), "source")


def routes(pairs: DataFrame) -> DataFrame:
    """(brand, final, path): where the rows of each source end, and the merges (at, source, target) that bring them there, when
    ``pairs`` (source, target, at) are carried out by ``at``. What left a brand before something comes to it is not followed.
    """
    events = pairs.select(F.col("target").alias("brand"), "at", F.lit(0).alias("leaves")).union(pairs.select("source", "at", F.lit(1)))
    later = Window.partitionBy("brand").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    out = F.last(F.when(F.col("leaves") == 1, F.col("at")), ignorenulls=True).over(later)
    onward = events.withColumn("next", out).where("leaves = 0").select("at", "next")
    steps = pairs.join(onward, "at").select(F.col("at").alias("node"), "next", F.array(F.struct("at", "source", "target")).alias("path"))
    paths = _jumped(steps)
    first = pairs.groupBy("source").agg(F.min("at").alias("node"))
    return first.join(paths, "node").select(F.col("source").alias("brand"), F.element_at("path", -1).target.alias("final"), "path")


def merge_brands(radio: DataFrame, pairs: DataFrame, fields: Sequence[str] = MERGE_FIELDS) -> DataFrame:
    """``radio`` (brand, model, fields, notes) after all merges of ``pairs`` (source, target, and their turns ``at``; without
    ``at``, as ``in_order`` gives): the same as ``merge_brand`` for one pair after another, in one aggregate.

    A row of the result is the first by the way it came: the brand's own, then what was merged into it by turn, each with what
    it had taken in before. Blank fields take the first value that isn't blank in this order; notes are put together merge by
    merge. (brand, model) is unique. Only rows of brands that pairs name are grouped; of a model's only notes are collected.
    """
    if "at" not in pairs.columns:
        pairs = in_order(pairs)
    elif pairs.where("source = target").limit(1).count():
        raise ValueError("source and target are the same brand")
    way = routes(pairs).withColumnRenamed("brand", "_source")
    ends = way.select(F.col("final").alias("_end")).distinct()
    joined = radio.join(way, F.col("brand") == F.col("_source"), "left").join(ends, F.col("brand") == F.col("_end"), "left")
    moved = joined.where("_source is not null or _end is not null")
    moved = moved.withColumn("_final", F.coalesce("final", "brand")).withColumn("path", F.coalesce("path", F.array().cast(dict(way.dtypes)["path"])))
    rank = F.transform(F.reverse("path"), lambda p: p.at)  # the last merge first: shorter ways go before longer ones
    filled = [c for c in fields if c in radio.columns and c not in ("notes", "brand", "model")]
    # Of nothing but blanks the last stays, as each takes the place of the one before.
    first = [F.coalesce(F.min_by(F.col(c), F.when(~blank(radio, c), rank)), F.max_by(c, rank)).alias(f"_f_{c}") for c in filled]
    told = F.collect_list(F.struct("brand", text(F.col("notes")).alias("notes"), "path")) if "notes" in radio.columns else F.array()
    one = moved.groupBy("_final", "model").agg(F.min_by(F.struct(*radio.columns), rank).alias("_row"), told.alias("_told"), *first)
    merges = F.array_sort(F.array_distinct(F.flatten(F.transform("_told", lambda t: t.path))))
    state = F.map_from_entries(F.transform("_told", lambda t: F.struct(t.brand, t.notes)))

    def step(m: Column, e: Column) -> Column:
        mine, other = F.try_element_at(m, e.target), F.try_element_at(m, e.source)
        new = F.when(mine.isNull(), other).otherwise(joined_notes(mine, other))
        rest = F.map_filter(m, lambda k, _: (k != e.source) & (k != e.target))
        return F.when(other.isNull(), m).otherwise(F.map_concat(rest, F.create_map(e.target, new)))

    notes = F.when(F.size("_told") == 1, F.col("_row.notes") if "notes" in radio.columns else F.lit(None)).otherwise(F.try_element_at(F.aggregate(merges, state, step), F.col("_final"))) if "notes" in radio.columns else None

    def value(c: str) -> Column:
        own = F.col(f"_row.{c}")
        found = {"brand": F.col("_final"), "model": F.col("model"), "notes": notes}
        return (found[c] if c in found else F.col(f"_f_{c}") if c in filled else own).alias(c)

    stay = joined.where("_source is null and _end is null").select(*radio.columns)
    return stay.unionByName(one.select(*map(value, radio.columns)))


def clean_prefixes(radio: DataFrame, codes: DataFrame, fields: Sequence[str] = MERGE_FIELDS, order: str = "id") -> DataFrame:
    """``radio`` after ``clean_prefix`` of every pair of ``codes`` (brand, code), in one aggregate by brand and name. A brand has
    one code; null brands and blank codes are a ValueError."""
    if codes.where("brand is null or code is null or code = ''").limit(1).count():
        raise ValueError("a brand and a code are needed")
    if codes.distinct().groupBy("brand").count().where("count > 1").limit(1).count():
        raise ValueError("a brand has several codes")
    known = codes.distinct().select(F.col("brand").alias("_brand"), F.col("code").alias("_code"))
    joined = radio.join(known, F.col("brand") == F.col("_brand"), "left")
    has = F.startswith(F.col("model"), F.col("_code"))
    part = joined.where("_code is not null").withColumn("_had", has)
    part = part.withColumn("_name", F.when(has, strip_code_prefix(F.col("model"), F.col("_code"))).otherwise(F.col("model")))
    return joined.where("_code is null").select(*radio.columns).unionByName(fold_prefixed(part, radio, ["brand", "_name"], fields, order))


def rename_in_both(radio: DataFrame, brands: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, Observation, Observation]:
    """``radio`` (brand) and ``brands`` (name) with names of ``mapping`` (source, target) replaced by the ends of their chains, and
    what tells the number of rows renamed in each (``renamed``), once the frames have been written: nothing is read for it.
    """
    ways = routes(in_order(mapping)).select(F.col("brand").alias("_old"), "final")
    out = []
    for df, column in ((radio, "brand"), (brands, "name")):
        joined, seen = df.join(ways, F.col(column) == F.col("_old"), "left"), Observation()
        counted = joined.observe(seen, F.count("_old").alias("renamed"))
        out.append((counted.withColumn(column, F.coalesce("final", column)).select(*df.columns), seen))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def rename_counts(radio: DataFrame, brands: DataFrame, mapping: DataFrame) -> DataFrame:
    """(radios, brands): how many rows of each table ``rename_in_both`` renames, as one row."""
    ways = mapping.select(F.col("source").alias("_old")).distinct()
    hits = radio.join(ways, F.col("brand") == F.col("_old")).select(F.lit("radios").alias("of"))
    hits = hits.unionAll(brands.join(ways, F.col("name") == F.col("_old")).select(F.lit("brands")))
    return hits.agg(*(F.count_if(F.col("of") == n).alias(n) for n in ("radios", "brands")))
