from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalyard.operators.upsert import upsert
from catalyard.sources import readers, writers
from catalyard.sources.parted import PartedTable
from catalyard.streaming.batches import upsert_stream


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_csv_round_trip(spark, tmp_path):
    src = tmp_path / "m.csv"
    src.write_text('Model,Brand,Display\nUV,Bao,"1.77"" TFT"\nX,Y\n')
    df = readers.read_catalog_csv(spark, str(src), ["Model", "Brand", "Display"])
    assert rows(df) == [("UV", "Bao", '1.77" TFT'), ("X", "Y", "")]
    writers.write_csv(df, str(tmp_path / "out"))
    back = readers.read_catalog_csv(spark, str(tmp_path / "out"), ["Brand", "Model", "Display"])
    assert rows(back) == [("Bao", "UV", '1.77" TFT'), ("Y", "X", "")]


def test_grants_xml(spark, tmp_path):
    src = tmp_path / "g.xml"
    src.write_text("<Results><Row><applicant_name> A & B </applicant_name><fcc_id>2AX</fcc_id></Row>\n<Row><fcc_id>Z-1</fcc_id><city/></Row></Results>")
    got = readers.read_grants_xml(spark, str(src))
    assert rows(got.select("applicant_name", "fcc_id", "city")) == [("", "Z-1", ""), ("A & B", "2AX", "")]
    assert rows(readers.read_grants_xml(spark, str(src), "ISO-8859-1").select("fcc_id")) == [("2AX",), ("Z-1",)]
    empty = tmp_path / "e.xml"
    empty.write_text("<Results></Results>")
    assert readers.read_grants_xml(spark, str(empty)).count() == 0


def test_bad_records_are_set_aside(spark, tmp_path):
    src = tmp_path / "b.xml"
    src.write_bytes("<R><Row><fcc_id>É1</fcc_id></Row><Row><fcc_id>X<</Row><Row><fcc_id>2</fcc_id></Row></R>".encode("latin-1"))
    assert rows(readers.read_grants_xml(spark, str(src), "ISO-8859-1").select("fcc_id")) == [("2",), ("É1",)]
    assert readers.read_bad_grants(spark, str(src), "ISO-8859-1").count() == 1


def test_last_code_goes_by_file_and_place(spark, tmp_path):
    row = "<Row><grantee_code>A</grantee_code><grantee_name>{}</grantee_name></Row>"
    for name, n in (("b", 50), ("a", 300)):
        (tmp_path / f"{name}.xml").write_text("<R>" + "".join(row.format(f"{name}{i}") for i in range(n)) + "</R>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert rows(readers.read_grantee_map(spark, str(tmp_path))) == [("A", "b49")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_markdown_header_names_columns(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.md").write_text(f"text\n| Model | Brand |\n| :--- | --- |\n| {name} | x |\n")
    assert rows(readers.read_markdown_table(spark, str(tmp_path)).select("Model", "Brand")) == [("a", "x"), ("b", "x")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none/n.md").write_text("no table\n")
    assert readers.read_markdown_table(spark, str(tmp_path / "none"), ["m"]).count() == 0


def files(where):
    """Names and sizes of the data files of each part."""
    return {d.name: {(f.name, f.stat().st_size) for f in d.glob("*.parquet")} for d in Path(where).iterdir() if d.name.startswith("part=")}


def test_reload(spark, tmp_path):
    table, schema = PartedTable(str(tmp_path / "t"), ("k",), 4), "k string, v string, at int"
    go = lambda clear, *r: rows(writers.reload(spark.createDataFrame(list(r), schema), table, ["v"], ["at"], clear))
    assert go(False, ("a", "1", 1), ("b", "1", 1), (None, "0", 1)) == [("a", "1"), ("b", "1"), (None, "0")]
    assert go(False, ("a", "2", 2), ("a", "3", 3)) == [("a", "3"), ("b", "1"), (None, "0")]
    assert go(True, ("c", "1", 1)) == [("c", "1")]
    assert go(True) == []


def test_an_upsert_touches_its_own_parts(spark, tmp_path):
    table = PartedTable(str(tmp_path / "t"), ("k", "j"), 32)
    old = spark.range(20_000).select(F.concat(F.lit("key "), "id").alias("k"), (F.col("id") % 3).alias("j"), F.lit("old").alias("v"), F.col("id").alias("w"))
    table.create(old)
    before = files(table.path)
    assert len(before) == 32 and all(len(f) == 1 for f in before.values())
    batch = spark.createDataFrame([("key 7", 1, "new", 0, 1), ("key 7", 1, "newer", 0, 2), ("key 20000", 2, "new", 5, 1)], "k string, j long, v string, w long, at int")
    tally = table.upsert(batch, ["v"], ["at"])
    after = files(table.path)
    changed = {p for p in before if before[p] != after[p]}
    assert {k: tally[k] for k in ("created", "updated", "skipped", "total")} == {"created": 1, "updated": 2, "skipped": 0, "total": 3}
    assert len(changed) == tally["parts"] == len(table.touched(batch)) <= 2
    assert sum(n for p in changed for _, n in after[p]) < 0.1 * sum(n for f in before.values() for _, n in f)
    want = rows(upsert(old, batch, ["k", "j"], ["v"], ["at"]).select("k", "j", "v", "w"))
    assert rows(table.read(spark)) == want
    assert table.upsert(batch, ["v"], ["at"])["created"] == 0 and rows(table.read(spark)) == want  # a repeated batch changes nothing
    assert table.upsert(batch.withColumn("v", F.lit("x")), ["v"], ["at"], overwrite=False)["skipped"] == 3 and rows(table.read(spark)) == want
    assert table.upsert(batch.limit(0), ["v"], ["at"])["total"] == 0 and rows(table.read(spark)) == want
    plan = table._stored(spark).where(F.col("part").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_a_failed_batch_can_be_given_again(spark, tmp_path):
    """Parts that were replaced before a failure are brought to the same state."""
    table = PartedTable(str(tmp_path / "t"), ("k",), 8)
    table.create(spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    batch = spark.range(50, 150).select(F.col("id").alias("k"), F.lit("new").alias("v"), F.lit(1).alias("at"))
    bad = batch.withColumn("v", F.when(F.col("k") == 149, F.raise_error(F.lit("stop"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        table.upsert(bad, ["v"], ["at"])
    assert {r.v for r in table.read(spark).collect()} == {"old"} and table.read(spark).count() == 100
    table.upsert(batch.where("k < 100"), ["v"], ["at"])  # as if some parts had been replaced
    table.upsert(batch, ["v"], ["at"])
    assert rows(table.read(spark)) == sorted([(k, "old" if k < 50 else "new") for k in range(150)], key=str)


def test_grantee_map_last_wins(spark, tmp_path):
    src = tmp_path / "r.xml"
    row = "<Row><grantee_code>{}</grantee_code><grantee_name>{}</grantee_name></Row>"
    src.write_text("<R>" + "".join(row.format(*x) for x in [("A", "1"), ("", "x"), ("A", "2"), ("AB", "")]) + "</R>")
    assert rows(readers.read_grantee_map(spark, str(src))) == [("A", "2"), ("AB", "")]


def test_markdown_shift(spark, tmp_path):
    src = tmp_path / "t.md"
    src.write_text("| Model | Brand | Web |\n| :--- | :--- | :--- |\n| A | | w |\n| B | x | y---z |\n")
    cols = ["model", "brand", "web"]
    assert rows(readers.read_markdown_table(spark, str(src), cols).select(*cols)) == [("A", "", "w"), ("B", "x", "y---z")]
    assert rows(readers.read_markdown_table(spark, str(src), cols, compat=True).select(*cols)) == [("A", "w", "")]


HTML = (
    '<table class="x table"><tbody><tr><td><a href="/r/1">Yaesu VX-1R</a></td><td>3</td><td>May</td><td>$9</td><td>x (4.5)</td></tr>'
    "<tr><td>no link</td><td></td><td></td><td></td><td></td></tr><tr><td><a>short</a></td></tr></tbody></table>"
)


def test_product_pages(spark):
    named = "<table><tr><th>No</th><th>Product Name</th></tr><tr><td>1</td><td> Icom </td></tr><tr><td>2</td><td></td></tr></table>"
    links = '<a href="/reviews/1">Long name</a><a href="/reviews/2">abc</a><a href="/x">other one</a>'
    pages = spark.createDataFrame([(1, HTML), (2, named), (3, links), (4, None)], "page_id long, html string")
    got = readers.parse_product_table(pages, ["Yaesu"]).select("page_id", "manufacturer", "model", "msrp", "rating")
    assert rows(got) == [(1, "Yaesu", "VX-1R", "$9", "4.5")]
    assert rows(readers.extract_named_column(pages, "Product Name", "/reviews/")) == [(1, "Yaesu VX-1R"), (1, "short"), (2, "Icom"), (3, "Long name")]
    assert rows(readers.link_texts(pages, "/reviews/")) == [(3, "Long name")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (2, "a")], "id int, t string")
    writers.write_json(df, str(tmp_path / "j"))
    assert rows(readers.read_json(spark, str(tmp_path / "j"), df.schema)) == [(1, "b"), (2, "a")]
    writers.write_text_lines(df, str(tmp_path / "l"), "t")
    assert rows(spark.read.text(str(tmp_path / "l"))) == [("a",), ("b",)]
    writers.save_table(df, str(tmp_path / "t"))
    writers.save_table(df, str(tmp_path / "t"))
    assert readers.load_table(spark, str(tmp_path / "t")).count() == 4
    writers.save_table(df, str(tmp_path / "t2"), clear=True)
    n, first = writers.preview(readers.load_table(spark, str(tmp_path / "t2")), "id", 1)
    assert (n, rows(first)) == (2, [(1, "b")])


def test_upsert_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, v string, at int"
    spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], schema).coalesce(1).write.parquet(src)
    stream, table, told = spark.readStream.schema(schema).parquet(src), PartedTable(out, ("k",), 16), []
    go = lambda: upsert_stream(stream, table, ["v"], ["at"], str(tmp_path / "cp"), lambda n, t: told.append((n, t["created"], t["total"]))).awaitTermination(60)
    go()
    before = files(out)
    spark.createDataFrame([("a", "3", 3), ("b", "1", 3)], schema).coalesce(1).write.mode("append").parquet(src)
    go()
    assert rows(table.read(spark)) == [("a", "3"), ("b", "1")] and told == [(0, 1, 2), (1, 1, 2)]
    assert sum(before.get(p) != f for p, f in files(out).items()) <= 2
