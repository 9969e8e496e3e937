"""Connected components by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

#: A node with more edges than HUB, and more than one in HUBS of all, is a hub.
HUB, HUBS = 256, 50_000


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def _with_least(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``rows`` (u, v) with m of ``least`` (u, m, n). Nodes of over ``most`` rows get theirs from a broadcast, and their rows
    are dealt by both ends, so that a hub's rows meet in no task."""
    hubs = least.where(F.col("n") > most).select("u", F.col("m").alias("hub_m"))
    # pmod(n, 1) is 0, but not to the optimiser, which would deal by u alone.
    rest = least.where(F.col("n") <= most).select("u", F.pmod("n", F.lit(1)).alias("salt"), "m")
    dealt = rows.join(F.broadcast(hubs), "u", "left")
    dealt = dealt.withColumn("salt", F.when(F.col("hub_m").isNull(), F.lit(0)).otherwise(F.xxhash64("v")))
    return dealt.join(rest, ["u", "salt"], "left").select("u", "v", F.coalesce("hub_m", "m").alias("m"))


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    out = _with_least(both, least, most).where("v > u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    out = _with_least(down, least, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), component being its smallest reachable node.

    Null ends, loops and repeated edges are ignored; nodes without an edge are not in the result. Each round is
    two grouped minima and joins; what a round leaves is written to the shared folder. A hub's neighbours meet only
    in a minimum, which combines before the shuffle. Nodes with more than ``HUB`` edges, or one in ``HUBS`` of the edges if
    that is more, are hubs: 2 * HUBS of them at most are broadcast. The rounds end when the edges stop changing, after
    about the logarithm of the longest path; ``rounds`` only guards against a bug.
    """
    now = edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct()
    now = stored(now, "edges")
    before = _signature(now)
    for _ in range(rounds):
        if not before[0]:
            break
        most = max(HUB, before[0] // HUBS)
        then = stored(_small_star(_large_star(now, most), most), "edges")
        discard(now)
        now, after = then, _signature(then)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
