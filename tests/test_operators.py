import pytest
from pyspark.sql import functions as F

from catalyard.operators import maintain, matching, reports, upsert


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_catalogs_keeps_the_first(spark):
    m = frame(spark, "ordinal int, brand string, model string, dmr string", (2, "icom", "ic-1", "b"), (1, "ICOM", "IC-1", "a"))
    a = frame(spark, "ordinal int, brand string, model string, gps string", (1, " Icom ", "ic-1 ", "x"), (2, "K-po", "x", None))
    got = rows(matching.merge_catalogs(m, a).select("brand", "model", "dmr", "gps"))
    assert got == [("Icom", "IC-1", "a", ""), ("K-Po", "x", "", "")]
    assert rows(reports.top_brands(matching.merge_catalogs(m, a))) == [("Icom", 1), ("K-Po", 1)]
    assert matching.merge_catalogs(m.limit(0), a.limit(0)).count() == 0


def test_new_models_keeps_repeats(spark):
    p = frame(spark, "brand string, model string", ("a", "x"), ("b", "y"), ("b", "y"), ("b", ""), (None, "z"))
    m = frame(spark, "brand string, model string", ("A", "X "))
    assert rows(matching.new_models(p, m)) == [("b", "y"), ("b", "y")]


def test_reconcile(spark):
    a = frame(spark, "brand string, model string", ("a", "x"), ("A", "X"), ("b", "y"))
    b = frame(spark, "brand string, model string", ("B", "Y"), ("c", "z"))
    assert rows(matching.reconcile(a, b)) == [("A", "X", "first"), ("C", "Z", "second")]


def test_longest_code_wins(spark):
    ids = frame(spark, "fcc_id string", ("2AJTBX6",), ("2AJ-1",), ("ZZZ",), (None,))
    codes = frame(spark, "code string", ("2AJ",), ("2AJTB",), ("",), ("2AJ",))
    assert rows(matching.resolve_grantee(ids, codes)) == [("2AJ-1", "2AJ", "1"), ("2AJTBX6", "2AJTB", "X6"), ("ZZZ", None, "ZZZ"), (None, None, None)]


def test_names_flags_and_brands(spark):
    n = frame(spark, "code string, name string", ("a", None), ("b", "B"))
    assert rows(matching.grantee_name(frame(spark, "code string", ("a",), ("b",), ("c",)), n)) == [("a", None), ("b", "B"), ("c", "c")]
    reg = frame(spark, "fcc_id string", ("AB1UV5",), ("AB1-X",), ("AB12-Z",), (None,))
    made = frame(spark, "code string, fcc_id string", ("AB1", "AB1-UV5"), ("AB1", "AB1-X"), ("AB1", "AB1-2-Z"), ("", ""))
    found = matching.flag_exists(made, reg, frame(spark, "code string", ("AB1",), ("AB12",)))
    assert rows(found.select("fcc_id", "exists")) == [("", ""), ("AB1-2-Z", "No"), ("AB1-UV5", "Yes"), ("AB1-X", "Yes")]
    got = matching.missing_brands(frame(spark, "brand string", ("p",), ("q",), ("",)), frame(spark, "name string, code string", ("p", "1")))
    assert rows(got) == [("p", "1"), ("q", None)]


def test_upsert_counts_repeats(spark):
    t = frame(spark, "k string, v string, w string", ("a", "0", "0"), ("b", "0", "0"))
    b = frame(spark, "k string, v string, w string, at int", ("a", "1", "1", 1), ("a", "2", "2", 2), ("c", "1", "1", 1), ("c", "2", "2", 2))
    over = upsert.upsert(t, b, ["k"], ["v"], ["at"])
    assert rows(over) == [("a", "2", "0", "updated", 2), ("b", "0", "0", "kept", 0), ("c", "2", "2", "created", 2)]
    assert rows(upsert.tally(over)) == [(1, 3, 0, 0, 4)] and rows(upsert.tally(over, errors=b.limit(2))) == [(1, 3, 0, 2, 6)]
    kept = upsert.upsert(t, b, ["k"], ["v"], ["at"], overwrite=False)
    assert rows(kept) == [("a", "0", "0", "skipped", 2), ("b", "0", "0", "kept", 0), ("c", "1", "1", "created", 2)]
    assert rows(upsert.tally(kept, overwrite=False)) == [(1, 0, 3, 0, 4)]


def test_checks(spark):
    df = frame(spark, "a string, b string", ("x", "y"), ("x", "y"), (None, "y"), (None, "y"))
    assert rows(upsert.check_unique(df, ["a", "b"])) == [("x", "y", 2)]
    got = upsert.check_row(frame(spark, "a string, y string", ("long", ""), ("ok", "1.2.3"), ("ok", "2014.0")), {"a": 3}, "y")
    assert rows(got.select("error")) == [("a is too long",), ("y is no year",), (None,)]


def test_merge_brand(spark):
    r = frame(spark, "brand string, model string, gps string, notes string", ("s", "x", "yes", "n1"), ("t", "x", "", "n0"), ("s", "y", "no", ""), ("u", "z", "", ""))
    lone = frame(spark, "brand string, model string, gps string, notes string", (None, "q", "0", None))
    assert (None, "q", "0", None) in rows(maintain.merge_brand(r.union(lone), "s", "t", ["gps"]))
    got = rows(maintain.merge_brand(r, "s", "t", ["gps", "notes"]))
    assert got == [("t", "x", "yes", "n0\nn1"), ("t", "y", "no", ""), ("u", "z", "", "")]
    with pytest.raises(ValueError):
        maintain.merge_brand(r, "s", "s", [])


def test_clean_prefix_folds(spark):
    r = frame(spark, "id int, brand string, model string, gps string, notes string", (1, "b", "AB-x", "1", "p"), (2, "b", "ABx", "2", "q"), (3, "b", "x", "", "r"), (4, "c", "ABx", "", ""))
    assert rows(maintain.clean_prefix(r, "b", "AB", ["gps", "notes"])) == [(3, "b", "x", "1", "r\np\nq"), (4, "c", "ABx", "", "")]
    with pytest.raises(ValueError):
        maintain.clean_prefix(r, "b", "", [])


def test_dedupe_joins_notes(spark):
    r = frame(spark, "id int, brand string, model string, gps string, notes string", (1, "b", "x", "", "p"), (2, "b", "x", "2", "p"), (3, "b", "x", "", ""), (4, "c", "y", "", "only"))
    assert rows(maintain.dedupe_catalog(r, ["gps", "notes"])) == [(2, "b", "x", "2", "p\np"), (4, "c", "y", "", "only")]


def test_blank_goes_by_type(spark):
    """The number 0 is blank, the text 0 is not."""
    r = frame(spark, "id int, brand string, model string, gps string, battery_mah int, notes string", (1, "s", "x", "yes", 5, ""), (2, "t", "x", "0", 0, ""), (3, None, "y", "", 0, "a"), (4, None, "y", "", 7, "b"))
    assert rows(maintain.merge_brand(r, "s", "t"))[0] == (2, "t", "x", "0", 5, "")
    assert rows(maintain.best_rows(r, ["gps", "battery_mah"]).select("id")) == [(1,), (2,), (4,)]
    assert rows(maintain.dedupe_catalog(r, ["gps", "battery_mah"]).where("brand is null").select("id", "notes")) == [(4, "b\na")]
    c = frame(spark, "id int, brand string, model string, gps string, battery_mah int, notes string", (1, "b", "Px", "0", 0, "n"), (2, "b", "P-x", "1", 9, "n"))
    assert rows(maintain.clean_prefix(c, "b", "P")) == [(2, "b", "x", "1", 9, "n")]
    assert rows(maintain.clean_prefix(c.where("id = 1"), "b", "P")) == [(1, "b", "x", "0", 0, "n")]


def test_import_radios(spark):
    """A file with a repeated key, a bad year, a blank model and columns that are absent."""
    have = ", ".join(f"{c} {'int' if c in ('intro_year', 'battery_mah') else 'string'}" for c in upsert.RADIO_FIELDS)
    none = spark.createDataFrame([], f"brand string, model string, {have}")
    file = frame(spark, "Brand string, Model string, `Intro Year` string, `Battery (mAh)` string, GPS string, at int",
        ("HongXun ", "DP4801", "2014.0", "4200 (Adv)", "", 1), ("HongXun", " DP4801", "2015", "N/A (Mobile)", " yes ", 2), ("A", "", "", "", "", 3), ("A", "B", "1.2.3", "", "", 4), ("A", "C", "", "", "y" * 51, 5))
    table, bad = upsert.import_radios(none, file, "at")
    assert rows(table.select("brand", "model", "intro_year", "battery_mah", "gps", "website", "action", "times")) == [("HongXun", "DP4801", 2015, None, "yes", "", "created", 2)]
    assert rows(bad.select("at", "error")) == [(4, "_year is no year"), (5, "gps is too long")]
    assert rows(upsert.tally(table, errors=bad)) == [(1, 1, 0, 2, 4)]


def test_merges_count_what_goes(spark):
    m = frame(spark, "ordinal int, brand string, model string", (1, "icom", "a"), (2, "ICOM", "A "), (3, "K-po", "x"))
    assert rows(matching.merge_counts(m, m)) == [(6, 2, 4)]
    assert rows(matching.merge_counts(m.limit(0), m.limit(0))) == [(0, 0, 0)]


def test_first_and_last_take_nulls_and_lone_keys(spark):
    r = frame(spark, "k string, a int, b string", ("x", None, "n"), ("x", 1, "o"), (None, 2, "p"), (None, 3, None))
    assert rows(matching.first_wins(r, ["k"], [F.col("a")])) == [("x", None, "n"), (None, 2, "p")]
    assert rows(matching.last_wins(r, ["k"], ["a"])) == [("x", 1, "o"), (None, 3, None)]
    assert rows(matching.first_wins(r.select("k"), ["k"], [F.col("k")])) == [("x",), (None,)]


def test_merge_selected_and_deletes(spark):
    r = frame(spark, "id int, brand string, model string, gps string", (1, "b", "x", "1"), (2, "a", "x", "2"), (3, "c", "z", ""))
    g = frame(spark, "group_id int, id int", (7, 1), (7, 2), (8, 3))
    p = frame(spark, "group_id int, field string, id int", (7, "gps", 1))
    more = r.union(frame(spark, "id int, brand string, model string, gps string", (4, "d", "w", "4")))
    assert rows(maintain.merge_selected(more, g, p, ["model", "gps"])) == [(2, "a", "x", "1"), (3, "c", "z", ""), (4, "d", "w", "4")]
    assert rows(maintain.delete_ids(r, frame(spark, "id int", (1,), (1,))).select("id")) == [(2,), (3,)]


def test_reports(spark):
    r = frame(spark, "id int, brand string, model string, fcc_id string", (1, "Ab%", "x", None), (2, "b", "AB%", ""), (3, "c", "y", "ab"))
    assert rows(reports.search(r, "b%").select("id")) == [(1,), (2,)]
    assert reports.search(r, " ").count() == 3
    pages = frame(spark, "k string, t string", ("a", "ab1-x AB1-y zz9-q"), ("a", None), ("b", "none"))
    assert rows(reports.most_common_code(pages, "k", "t")) == [("a", "AB1")]
    assert rows(reports.facets(r, ["brand"]))[0] == ("brand", "Ab%", 1)
    assert [x.id for x in reports.page(r, 2, 2).collect()] == [3] == [x.id for x in reports.page_after(r, "b", "AB%", 2, 2).collect()]
    assert rows(reports.facet_filter(r, brand="Ab%", fcc_id=None).select("id")) == [(1,)]
    finds = frame(spark, "brand string, body string", ("b", "id AB1-X"), ("c", "none"))
    assert rows(reports.manual_queue(r, r.limit(0).select("brand"), finds, "id", "u?").select("brand")) == [("Ab%",), ("c",)]
