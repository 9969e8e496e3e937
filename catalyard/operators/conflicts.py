"""Rows that claim unique names in file order: which of them stand, and which fail and change nothing.

A code has one name at a time and a name one code. A row claims a name for its code; it fails if another code has that name when
its turn comes. Claims are decided by names, many at once, in rounds: what a name's owner does next says up to where other
claims on it must fail. Rows that no other code can disturb stand from the start; when those left are few, they are replayed
one after another in one task of bounded size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import forget, written

#: Undecided claims that are replayed one by one in one task, at most.
REPLAY = 50_000
#: Positions that one window spans; a code's rows are looked at in such runs.
SPAN = 4096


def _following(rows: DataFrame) -> DataFrame:
    """``rows`` (pos, code, name, status) with ``next``: pos and status of the code's first later row of another name, if any.

    Windows hold a code's rows within a run of SPAN positions; what lies beyond comes from a row for each code and run."""
    rows = rows.withColumn("run", F.floor(F.col("pos") / SPAN))
    runs = rows.groupBy("code", "run").agg(F.max_by("name", "pos").alias("last_name"))
    over_runs = Window.partitionBy("code").orderBy("run")
    runs = runs.select("code", "run", F.lag("last_name").over(over_runs).alias("name_before"))
    inside = Window.partitionBy("code", "run").orderBy("pos")
    before = F.coalesce(F.lag("name").over(inside), F.col("name_before"))
    rows = rows.join(runs, ["code", "run"]).withColumn("starts", ~before.eqNullSafe(F.col("name")))
    start = F.when(F.col("starts"), F.struct("pos", "status"))
    later = Window.partitionBy("code", "run").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("near", F.last(start, ignorenulls=True).over(later))
    far = rows.groupBy("code", "run").agg(F.min(start).alias("start"))
    beyond = Window.partitionBy("code").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    far = far.select("code", "run", F.last("start", ignorenulls=True).over(beyond).alias("far"))
    return rows.join(far, ["code", "run"]).withColumn("next", F.coalesce("near", "far")).drop("run", "name_before", "starts", "near", "far")


def _round(rows: DataFrame) -> DataFrame:
    """Decides what can be decided. ``rows``: pos, code, name, status (ok or pending; failed ones are gone), with the stored
    owners as ok rows before the file; failed rows come back with the status error.

    A name's claims are decided in order, so its last row that stands names its owner. Up to the owner's next row of another
    name, other codes' claims fail and its own stand. If that row stands, the name is free after it, and the first claim
    then stands; if it is undecided, claims after it wait. A name without an owner goes to its first claim."""
    chain = _following(rows)
    owner = chain.where("status = 'ok'").groupBy("name").agg(F.max_by(F.struct("code", "next"), "pos").alias("owner"))
    until = F.col("owner.next.pos")
    free = F.col("owner").isNull() | (F.col("owner.next.status") == "ok")
    judged = rows.join(owner, "name", "left")
    held = F.col("owner").isNotNull() & (until.isNull() | (F.col("pos") < until))
    status = F.when(F.col("status") == "ok", "ok").when(held, F.when(F.col("owner.code") == F.col("code"), "ok").otherwise("error"))
    judged = judged.withColumn("judged", F.coalesce(status, F.when(free, "first").otherwise("pending")))
    first = judged.where("judged = 'first'").groupBy("name").agg(F.min("pos").alias("first_pos"))
    judged = judged.join(first, "name", "left")
    stands = F.when(F.col("judged") != "first", F.col("judged")).when(F.col("pos") == F.col("first_pos"), "ok").otherwise("pending")
    return judged.select("pos", "code", "name", stands.alias("status"))


def _replayed(df: pd.DataFrame) -> pd.DataFrame:
    """Rows in order: a claim stands where no other code has its name at that time; ok rows stand in any case."""
    name_of: dict[str, str] = {}
    owner: dict[str, str] = {}
    status = []
    df = df.sort_values("pos")
    for code, name, known in zip(df["code"], df["name"], df["status"]):
        stands = known == "ok" or owner.get(name, code) == code
        if stands:
            old = name_of.get(code)
            if old is not None and owner.get(old) == code:
                del owner[old]
            name_of[code], owner[name] = name, code
        status.append("ok" if stands else "error")
    return df.assign(status=status)[["pos", "code", "name", "status"]]


def renames(owners: DataFrame, claims: DataFrame, replay: int = REPLAY) -> DataFrame:
    """``claims`` (pos, code, name) with status: ok, or error where another code has the name at that time.

    ``owners`` (code, name) is the state before. A claim that stands gives its code the name and frees the one it had. pos is
    unique, at least 0, and dense in runs, as numbers of rows are. Owners without a code keep their names; empty names are
    nobody's. Names are compared as they are; null codes and names don't claim, so ``claims`` has none.

    Names that only one code ever touches are out of question: their claims stand, and only codes that also touch other
    names take part in rounds. Each round decides all names as far as their owners allow, so there are as many rounds as a name
    changes hands in a chain of codes; when ``replay`` undecided claims or fewer, with the rows of their codes, are left,
    one task replays them.
    """
    code = F.coalesce(F.concat(F.lit("c"), F.col("code")), F.concat(F.lit("-"), F.col("name")))  # without a code: its own
    owned = owners.where("name <> ''").select(F.lit(-1).cast("long").alias("pos"), code.alias("code"), "name", F.lit("ok").alias("status"))
    claimed = claims.select(F.col("pos").cast("long"), code.alias("code"), "name", F.lit("pending").alias("status"))
    both = owned.unionByName(claimed)
    touched = both.groupBy("name").agg((F.min("code") != F.max("code")).alias("contested"))
    marked = both.join(touched, "name").withColumn("status", F.when(~F.col("contested"), "ok").otherwise(F.col("status")))
    codes = marked.where("contested").select("code").distinct()
    calm = claimed.join(codes, "code", "left_anti").withColumn("status", F.lit("ok"))
    left = written(marked.join(codes, "code", "left_semi").select("pos", "code", "name", "status"), "claims")
    done = []
    while True:
        pending = left.where("status = 'pending'").count()
        if not pending:
            break
        # Rows of names that all stand by now still say when their codes leave a name.
        if left.count() <= replay:
            last = left.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_replayed, left.schema)
            left = written(last, "claims")
            break
        after = written(_round(left), "claims")
        done.append(after.where("status = 'error'"))
        left = after.where("status <> 'error'")
    out = left.unionByName(calm)
    for d in done:
        out = out.unionByName(d)
    return out.where("pos >= 0").select("pos", F.expr("substr(code, 2)").alias("code"), "name", "status")


def first_claims(taken: DataFrame, named: DataFrame, claims: DataFrame) -> DataFrame:
    """``claims`` (pos, code, name) with status where a code keeps the first name that it gets: ok, kept (the code has a name by
    then) or error (another code has the name).

    ``taken`` (name): names of the state before; ``named`` (code): codes that have one. A round lets every claim stand that is
    the first left of both its code and its name, and takes out the others of both. Of any claims left the first is such a
    one; names or codes that most rows have go at once.
    """
    taken, named = taken.select("name").distinct(), named.select("code").distinct()
    left = claims.select(F.col("pos").cast("long"), "code", "name").join(named, "code", "left_anti").join(taken, "name", "left_anti")
    left, stood, steps = written(left, "claims"), None, []
    while left.limit(1).count():
        by_code, by_name = (left.groupBy(k).agg(F.min("pos").alias(f"first_of_{k}")) for k in ("code", "name"))
        both = left.join(by_code, "code").join(by_name, "name")
        won = written(both.where("pos = first_of_code and pos = first_of_name").select("pos", "code", "name"), "claims-won")
        stood = won if stood is None else stood.unionByName(won)
        rest = left.join(won.select("code"), "code", "left_anti").join(won.select("name"), "name", "left_anti")
        steps.append(left)
        left = written(rest, "claims")
    for s in steps:
        forget(s)
    stood = left.select("pos", "code", "name") if stood is None else stood
    since = stood.select("code", F.col("pos").alias("since")).unionByName(named.select("code", F.lit(-1).cast("long").alias("since")))
    out = claims.select(F.col("pos").cast("long"), "code", "name").join(since, "code", "left")
    status: Column = F.when(F.col("pos") == F.col("since"), "ok").when(F.col("pos") > F.col("since"), "kept").otherwise("error")
    return out.select("pos", "code", "name", status.alias("status"))
