"""Imports of unique names in file order, against a replay row by row."""

import random

import pytest
from pyspark.sql import functions as F

from catalyard.operators import conflicts, upsert

FIELDS = upsert.BRAND_FIELDS[1:]

#: A maker file: names and the codes they claim.
MAKERS = """Alinco C4Z, Anytone 2AJDM, Azden FRH, Baofeng 2AJGM, Baojie 2AFPR, Bintolk 2AJGM, Btech 2AJGM, Connect XH8, Eagle 2AJGM, Hongxun 2AL5L,
Icom AFJ, Iradio 2AO8L, Jingtong 2AJGM, Kenwood ALH, Luiton 2AO8L, Marantz FNA, Maxon HBG, Midland K4R, Motorola AZ489, Pofung 2AJGM, Puxing W7PPX,
Quansheng 2ANMZ, Shack FRS, Radioddity 2AJGM, Radtel 2AZSA, Retevis 2AHVB, Retevis 2AO3E, Rexon IJJ, Ritron JZP, Ruyage 2AN5D, Sainsionic 2AJGM,
Senhaix 2AWSI, Soontone 2AJGM, Standard K66, Tekk 2AJGM, Tera 2AL5L, Tidradio 2AUIUTD, Tyt 2AMJR, Vero 2AJGM, Vertex K6620, Wln 2ASNS, Wouxun U4Z,
Yaesu K6620, Zastone 2AM7H"""


def brands(spark, rows):
    df = spark.createDataFrame(rows, "code string, name string, at long" if rows and len(rows[0]) == 3 else "code string, name string")
    return df.select("*", *(F.lit("").alias(c) for c in FIELDS))


def replay_brands(stored, file):
    """(code -> name, per row ok)."""
    name_of, nameless = {c: n for c, n in stored if c is not None}, {n for c, n in stored if c is None}
    verdict = {}
    for code, name, at in sorted(file, key=lambda r: r[2]):
        clash = name in nameless or any(n == name and c != code for c, n in name_of.items())
        if not clash:
            name_of[code] = name
        verdict[at] = not clash
    return name_of, verdict


def replay_grantees(stored, file):
    name_of, verdict = dict(stored), {}
    for code, name, at in sorted(file, key=lambda r: r[2]):
        if name_of.get(code):
            verdict[at] = "kept"
        elif name in name_of.values():
            verdict[at] = "error"
        else:
            name_of[code], verdict[at] = name, "ok"
    return name_of, verdict


def cases(seed):
    rng = random.Random(seed)
    codes, names = [f"C{i}" for i in range(rng.choice([2, 5, 12]))], [f"N{i}" for i in range(rng.choice([2, 4, 9]))]
    free = rng.sample(names, len(names))
    stored = [(c, free.pop()) for c in codes if free and rng.random() < 0.5]
    n = rng.choice([5, 30, 60])
    places = rng.sample(range(n * rng.choice([1, 400])), n)
    return stored, [(rng.choice(codes), rng.choice(names + [f"own {c}" for c in codes[:2]]), p) for p in places]


@pytest.mark.parametrize("replay", [0, 50_000])
def test_renames_match_a_replay(spark, monkeypatch, replay):
    """Many small files as one, their codes and names told apart: chains of names that change hands, in rounds and in one task."""
    monkeypatch.setattr(conflicts, "SPAN", 7 if not replay else 4096)
    stored, file, want = [], [], {}
    for seed in range(2 if not replay else 150):
        s, f = cases(seed)
        at = {p: len(file) + k for k, p in enumerate(sorted(r[2] for r in f))}
        mine = [(f"{seed}/{c}", f"{seed}/{n}", at[p]) for c, n, p in f]
        s = [(f"{seed}/{c}", f"{seed}/{n}") for c, n in s] + ([(None, f"{seed}/N0")] if seed % 5 == 0 and not any(n == "N0" for _, n in s) else [])
        want |= replay_brands(s, mine)[1]
        stored, file = stored + s, file + mine
    claims = spark.createDataFrame(file, "code string, name string, pos long").repartition(3)
    got = conflicts.renames(spark.createDataFrame(stored, "code string, name string"), claims, replay).collect()
    assert {r.pos: r.status == "ok" for r in got} == want and len(got) == len(file)
    assert {(r.code, r.name, r.pos) for r in got} == set(file)
    assert 0.1 < sum(want.values()) / len(want) < 0.95


def test_first_claims_match_a_replay(spark):
    stored, file, want = [], [], {}
    for seed in range(80):
        s, f = cases(seed)
        at = {p: len(file) + k for k, p in enumerate(sorted(r[2] for r in f))}
        mine = [(f"{seed}/{c}", f"{seed}/{n}", at[p]) for c, n, p in f]
        s = [(f"{seed}/{c}", "" if seed % 3 == 0 else f"{seed}/{n}") for c, n in s]
        want |= replay_grantees(s, mine)[1]
        stored, file = stored + s, file + mine
    old = spark.createDataFrame(stored, "code string, name string")
    got = conflicts.first_claims(old.where("name <> ''"), old.where("name <> ''"), spark.createDataFrame(file, "code string, name string, pos long"))
    assert {r.pos: r.status for r in got.collect()} == want and {"ok", "kept", "error"} == set(want.values())


def test_a_rejected_row_changes_nothing(spark):
    """No stored row is lost: an earlier valid row of a code stands, whatever fails later."""
    old = brands(spark, [("C1", "N1"), ("C2", "N2"), (None, "Nobody's")])
    new = brands(spark, [("C2", "N1", 0), ("C3", "N9", 1), ("C3", "N1", 2), (" C4 ", "Nobody's", 3), ("C1", "N7", 4), ("C2", "N1", 5), ("", "x", 6), ("C9", " ", 7)])
    table, bad = upsert.import_brands(old, new, "at")
    got = {(r.code, r.name, r.action, r.times) for r in table.collect()}
    assert got == {("C1", "N7", "updated", 1), ("C2", "N1", "updated", 1), ("C3", "N9", "created", 1), (None, "Nobody's", "kept", 0)}
    assert {tuple(r) for r in bad.collect()} == {(0, "C2", "N1"), (2, "C3", "N1"), (3, "C4", "Nobody's")}
    assert tuple(upsert.tally(table, errors=bad).first()) == (1, 2, 0, 3, 6)


def test_a_maker_file_over_an_empty_table(spark):
    rows = [(m.rsplit(" ", 1)[1], m.rsplit(" ", 1)[0].strip(), i) for i, m in enumerate(MAKERS.replace("\n", " ").split(", "))]
    table, bad = upsert.import_brands(brands(spark, rows).drop("at").limit(0), brands(spark, rows), "at")
    count = upsert.tally(table, errors=bad).first()
    assert (len(rows), count.created, count.updated, count.errors, table.count()) == (44, 30, 13, 1, 30)
    assert table.where("code = '2AJGM'").first().name == "Vero" and [tuple(r)[1:] for r in bad.collect()] == [("2AO3E", "Retevis")]


def test_grantees_keep_what_they_have(spark):
    old = spark.createDataFrame([("C0", ""), ("C9", "Nine"), ("C8", None)], "code string, name string")
    new = spark.createDataFrame([("C1", "Alpha", 1), ("C1", "Zulu", 2), ("C2", " ", 3), ("C0", "Nine", 4), ("C3", "Nine", 5), ("C9", "Other", 6), ("C8", "Eight", 7), ("C5", "Zulu", 8)], "code string, name string, at long")
    table, bad = upsert.import_grantees(old, new, "at")
    assert {tuple(r) for r in table.collect()} == {("C0", "", "kept"), ("C1", "Alpha", "created"), ("C9", "Nine", "kept"), ("C8", "Eight", "filled"), ("C5", "Zulu", "created")}
    assert {tuple(r) for r in bad.collect()} == {(4, "C0", "Nine"), (5, "C3", "Nine")}


def test_empty_files_and_tables(spark):
    none = brands(spark, [("a", "b", 1)]).limit(0)
    table, bad = upsert.import_brands(none.drop("at"), none, "at")
    assert table.count() == bad.count() == 0
    table, bad = upsert.import_grantees(none.select("code", "name"), none, "at")
    assert table.count() == bad.count() == 0
