"""CSV files of differing headers, ragged rows and fields that span lines and splits, against Python's reader."""

import csv
import io
import random

import pytest

from catalyard.operators import matching, reports
from catalyard.sources import readers
from catalyard.sources.csv import leaves_open, read_csv


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def plain(files, columns):
    out = []
    for f in files:
        for r in csv.DictReader(io.StringIO(f.read_text(encoding="utf-8-sig"), newline="")):
            out.append(tuple((r.get(c) or "").replace("\r\n", "\n") for c in columns))
    return sorted(out)


def field(rng):
    return rng.choice(["", "a", "b c", ' 1.77" TFT', "x,y", 'say "hi"', "two\nlines", '"\n"', "\n\n", ",", '"', "é", "end,\n,", 'a""b', "0"])


def write(path, names, rows, rng):
    with path.open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\n", quoting=csv.QUOTE_ALL if rng.random() < 0.3 else csv.QUOTE_MINIMAL)
        w.writerow(names)
        for r in rows:
            w.writerow(r if any(r) else ["-"])  # no empty lines, which no reader takes for rows


def test_random_files_match_pythons_reader(spark, small_splits, tmp_path):
    rng = random.Random(11)
    for k in range(6):
        names = rng.sample(["Brand", "Model", "Web site", 'Size, "x"'], rng.choice([2, 3, 4]))
        write(tmp_path / f"f {k}.csv", names, [[field(rng) for _ in range(rng.choice([len(names), len(names), 1]))] for _ in range(40)], rng)
    write(tmp_path / "plain.csv", ["Model", "Brand"], [["m1", "b1"], ["m2"], ['1.77" TFT', "b3"], ["", "b4", "too", "long"]], rng)
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n \n\n")
    (tmp_path / "bom.csv").write_text("﻿Brand,Model\nx,y\n", encoding="utf-8")
    got = read_csv(spark, str(tmp_path), place="at")
    columns = [c for c in got.columns if c != "at"]
    assert sorted(columns) == sorted(["Brand", "Model", "Web site", 'Size, "x"'])
    files = [f for f in sorted(tmp_path.glob("*.csv")) if f.name != "blank.csv"]
    rows = got.orderBy("at").collect()
    assert sorted(tuple(r[c] for c in columns) for r in rows) == plain(files, columns)
    for f in files:  # in file order
        mine = [tuple(r[c] for c in columns) for r in rows if r["at"]["file"].endswith(f.name.replace(" ", "%20"))]
        assert sorted(mine) == plain([f], columns)
        names = next(csv.reader(io.StringIO(f.read_text(encoding="utf-8-sig"), newline="")), [])
        wide = [tuple((r.get(c) or "") for c in columns) for r in csv.DictReader(io.StringIO(f.read_text(encoding="utf-8-sig"), newline=""))]
        assert mine == wide, (f.name, names)


def test_quotes_in_a_line(spark):
    lines = ["", "a", '"', '""', '"""', 'a"', 'a,"', 'a,"b"', 'a,"b""', '"a"b"', 'x"y,"z', '"a","b', ',"",""', 'a""b,"']
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    got = {r.t: (r.c, r.o) for r in df.select("t", leaves_open(df.t).alias("c"), leaves_open(df.t, True).alias("o")).collect()}

    def walk(text, inside):
        fresh = True
        for k, ch in enumerate(text):
            if ch == '"':
                if inside:
                    inside, fresh = False, True
                elif fresh and (k == 0 or text[k - 1] in ',"'):
                    inside = True
            elif ch == "," and not inside:
                fresh = True
            elif not inside:
                fresh = False
        return inside

    assert got == {x: (walk(x, False), walk(x, True)) for x in lines}


def test_a_large_file_is_many_tasks(spark, small_splits, tmp_path):
    rows = "".join(f'm{i},"line one\nline {i}"\n' for i in range(200))
    (tmp_path / "m.csv").write_text("Model,Text\n" + rows)
    assert spark.read.text(str(tmp_path / "m.csv")).rdd.getNumPartitions() > 5
    got = {(r.Model, r.Text) for r in read_csv(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {(f"m{i}", f"line one\nline {i}") for i in range(200)}
    (tmp_path / "open.csv").write_text('Model,Text\na,"never\nclosed\nb,c\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "open.csv")).collect()] == [("a", "never\nclosed\nb,c")]


def test_named_columns_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Brand,Model,Brand\nx,y,z\nq\n")
    assert [tuple(r) for r in readers.read_catalog_csv(spark, str(tmp_path), ["Model", "Brand", "Web"]).collect()] == [("y", "z", ""), ("", "", "")]
    assert read_csv(spark, str(tmp_path / "a.csv"), columns=[]).columns == []


def test_two_catalogues_of_known_sizes_merge(spark, tmp_path):
    """A master of 153 rows and 601 ragged additions with other columns: 712 rows stay, 42 go, 74 brands, and known largest."""
    largest = {"Icom": 126, "Kenwood": 75, "Baofeng": 63, "Yaesu": 58, "Alinco": 50, "Radtel": 29, "Wouxun": 23, "Puxing": 20, "Retevis": 19, "Anytone": 15}
    others = {f"Maker-{chr(65 + i // 8)}{chr(97 + i % 8)}": 3 + (i < 42) for i in range(64)}
    keys = [(b, f"{b[:2]}-{k}") for b, n in (largest | others).items() for k in range(n)]
    rng = random.Random(2)
    rng.shuffle(keys)
    assert len(keys) == 712 and len(largest | others) == 74
    master, rest = keys[:152], keys[152:]
    master = [*master, master[7]]
    added = rest + rng.sample(master[:152], 41)
    with (tmp_path / "master.csv").open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Model", "Brand", "Display", "Website"])
        w.writerows([m, b, '1.77" TFT', "w"] for b, m in master)
    with (tmp_path / "added.csv").open("w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Brand", "Model", "Notes", "Display"])
        for i, (b, m) in enumerate(added):
            w.writerow([f" {b.upper()}", m.lower() + " ", *(["of\ntwo lines", "d"] if i % 10 == 0 else [])])
    one, two = (read_csv(spark, str(tmp_path / f), place="ordinal").withColumnsRenamed({"Brand": "brand", "Model": "model"}) for f in ("master.csv", "added.csv"))
    assert (one.count(), two.count()) == (153, 601)
    counts = matching.merge_counts(one, two).first()
    assert (counts.kept, counts.removed) == (712, 42)
    merged = matching.merge_catalogs(one, two)
    assert reports.totals(merged).first().n_brands == 74
    assert {r.brand: r.n for r in reports.top_brands(merged).collect()} == largest
    assert matching.reconcile(one, two).groupBy("side").count().orderBy("side").first()["count"] == 152 - 41
