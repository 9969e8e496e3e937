from pyspark.sql import functions as F

from catalyard.functions import text as X


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in rows.select(column(F.col("v"))).collect()]


def test_title_case_starts_words_after_signs(spark):
    assert one(spark, X.title_case, " k-po ", "C-STANDARD", "a1b", None, "élan vital") == ["K-Po", "C-Standard", "A1B", "", "Élan Vital"]


def test_models_and_numbers(spark):
    assert one(spark, X.normalize_model, " uv-5r\t", None) == ["UV-5R", ""]
    assert one(spark, X.parse_year, "2014.0", "2024", "", "n/a", "1.2.3", None) == [2014, 2024, None, None, None, None]
    assert one(spark, X.bad_year, "1.2.3", "2014.0", None) == [True, False, False]
    assert one(spark, X.parse_battery, "4200 (Adv)", "N/A (Mobile)", None) == [4200, None, None]


def test_split_product_name(spark):
    cases = {
        "Radio Shack PRO-1": ("Radio Shack", "PRO-1"),
        "New Radio Shack HTX": ("Radio Shack", "New  HTX"),
        "Connect Systems CS580": ("Connect Systems", "CS580"),
        "BaoFeng/Pofung UV-5R": ("Baofeng", "UV-5R"),
        "The Baofeng/Pofung GT-3": ("Baofeng", "The Baofeng/Pofung GT-3"),
        "yaesu VX-1R (2nd)": ("yaesu", "VX-1R"),
        "Icom - IC-V80 dual band HT": ("Icom", "IC-V80"),
        "Icom – IC-2": ("Icom", "IC-2"),
        "Icom IC-V8 (a) b (c)": ("Icom", "IC-V8"),
        "Icom IC-3 vhf mobile": ("Icom", "IC-3"),
        "AnyTone AT-1 – new": ("AnyTone", "AT-1"),
        "Icom IC-4 dual  band": ("Icom", "IC-4 dual  band"),
        "Kenwoodish T1": ("Kenwoodish", "T1"),
        "Puxing": ("Puxing", ""),
        "": ("", ""),
    }
    split = lambda c: X.split_product_name(c, ["Yaesu", "Icom", "Kenwood", "Puxing", "AnyTone"])
    assert [tuple(r) for r in one(spark, split, *cases)] == list(cases.values())


def test_ids(spark):
    assert one(spark, X.clean_code, "uv 5r (v2)/x-1", None) == ["UV5RX-1", ""]
    assert one(spark, lambda c: X.make_id(F.lit("AB1"), c), "uv-5r", "()", None) == ["AB1-UV-5R", None, None]
    assert [tuple(r) for r in one(spark, X.split_id, "A-B-C", "AB", None)] == [("A", "B-C"), ("", ""), ("", "")]
    assert one(spark, lambda c: X.strip_code_prefix(c, F.lit("AB1")), "AB1-- X ", "ZAB1") == ["X", "ZAB1"]
    assert one(spark, lambda c: X.compose_id(F.lit("Q"), c), "x-1", "x1") == ["Q-x-1", "Qx1"]
    assert one(spark, X.sanitize_xml, "a & b &amp; &#1; &ampx; &lt;") == ["a &amp; b &amp; &#1; &amp;ampx; &lt;"]


def test_bands(spark):
    rows = spark.createDataFrame([("1.8", "54"), ("136", "174"), ("300", "300"), ("400", "480"), ("x", "1"), ("1d", "2"), (None, "5")], "a string, b string")
    got = [r.bands for r in X.with_bands(rows, "a", "b").collect()]
    assert got == [["HF", "VHF"], ["VHF"], ["UHF", "VHF"], ["UHF"], [], [], []]


def test_messages(spark):
    counts = [F.lit(n) for n in (4, 3, 0, 1)]
    said = "Grantee X1 (Maker): Processed 4 records • 3 new radios added • 1 duplicates skipped"
    assert one(spark, lambda c: X.import_message(F.lit("X1"), F.lit("Maker"), *counts), "") == [said]
    assert one(spark, lambda c: X.search_url("u?", c, F.lit("a/b c")), "X Y") == ["u?X%20Y%20a/b%20c"]
    assert one(spark, lambda c: X.default_if_blank(c, "-"), "", None, "x") == ["-", "-", "x"]
