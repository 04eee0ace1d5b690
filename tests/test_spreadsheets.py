"""Spreadsheets as a data source: round trips, types, several files by name, promotion, and two-phase commit."""

from __future__ import annotations

import datetime
import decimal
import zipfile

import pytest
from pyspark.sql import functions as F

from cubelens.sources import batches, spreadsheets

DAY = datetime.datetime(2024, 2, 29, 13, 45, 7, 123457)
ROWS = [
    ("a & <b> \"c\"", 1, 1.5, True, DAY, datetime.date(2024, 2, 29), decimal.Decimal("12.50"), ["x"]),
    ("", -(2**60) - 1, -0.1, False, datetime.datetime(1900, 3, 1), datetime.date(1899, 1, 1), None, []),
    (None, None, None, None, None, None, decimal.Decimal("-0.01"), None),
    (" two  spaces \n line\ttab\r_x0041_\x07", 0, 1e300, True, datetime.datetime(1815, 6, 18, 1, 2, 3), datetime.date(9999, 12, 31), decimal.Decimal("0"), ["é"]),
    ("007", 5, float("nan"), None, DAY, None, None, None),
]
SCHEMA = "s string, i long, d double, b boolean, t timestamp_ntz, day date, m decimal(10,2), tags array<string>"


def test_round_trip_of_nulls_dates_and_booleans(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    spreadsheets.write(df.coalesce(1), f"{tmp_path}/out")
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == ["part-00000.xlsx"]
    got = spreadsheets.read(spark, f"{tmp_path}/out", schema="s string, i long, d double, b boolean, t timestamp_ntz, day date, m decimal(10,2), tags string, none int").collect()
    text = lambda tags: None if tags is None else "[" + ",".join(f'"{x}"' for x in tags) + "]"
    want = [(*r[:2], None if r[2] != r[2] else r[2], *r[3:7], text(r[7]), None) for r in ROWS]
    assert [tuple(r) for r in got] == want
    strings = spreadsheets.read(spark, f"{tmp_path}/out/part-00000.xlsx")
    assert strings.columns == df.columns and {t for _, t in strings.dtypes} == {"string"}
    first = strings.first()
    assert (first["i"], first["d"], first["b"], first["t"], first["s"]) == ("1", "1.5", "true", "2024-02-29 13:45:07.123457", ROWS[0][0])


def test_files_that_others_write(spark, tmp_path):
    """Shared and rich strings, gaps, styles of dates, errors, repeated and blank headers, several sheets."""
    main, rel = spreadsheets.MAIN[1:-1], spreadsheets.RELATIONS
    sheet = lambda rows: f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", sheet('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c><c r="D1" t="str"><v>day</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>2.50</v></c><c r="D3" s="1"><v>45351.5</v></c></row><row r="4"><c r="A4" t="e"><v>#N/A</v></c><c r="B4" t="b"><v>0</v></c><c r="D4" s="2"><v>3</v></c></row>'))
        z.writestr("xl/worksheets/s2.xml", sheet('<row><c t="inlineStr"><is><t>name</t></is></c></row><row><c><v>7</v></c></row>'))
    got = spreadsheets.read(spark, f"{tmp_path}/w.xlsx")
    assert got.columns == ["name", "name.1", "_c2", "day"]
    assert [tuple(r) for r in got.collect()] == [(None,) * 4, ("rich", None, "2.5", "2024-02-29 12:00:00"), (None, "false", None, "3")]
    every = spreadsheets.read(spark, f"{tmp_path}/w.xlsx", sheet="*", sheet_column="tab")
    assert every.rdd.getNumPartitions() == 2 and {(r["tab"], r["name"]) for r in every.collect()} == {("One", None), ("One", "rich"), ("Two", "7")}
    assert spreadsheets.read(spark, f"{tmp_path}/w.xlsx", sheet="Two").collect()[0]["name"] == "7"


def test_files_by_a_column_and_promotion_by_size(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 3).alias("k"), "id", F.repeat(F.lit("x"), F.when(F.col("id") % 3 == 1, 2000).otherwise(3).cast("int")).alias("text"))
    rows = rows.withColumn("to", F.concat_ws("/", F.lit("r0/zero_shot_hist"), F.concat(F.lit("batch_"), F.col("k").cast("string"))))
    for _ in range(2):  # the second time the files are replaced
        spreadsheets.write(rows, str(tmp_path / "run"), "to", ["id"], promote_bytes=10_000)
        found = sorted(str(p.relative_to(tmp_path / "run")) for p in (tmp_path / "run").rglob("*") if p.is_file())
        assert found == ["r0/zero_shot_hist/batch_0.xlsx", "r0/zero_shot_hist/batch_1.parquet", "r0/zero_shot_hist/batch_2.xlsx"]
    got = spreadsheets.read(spark, f"{tmp_path}/run/r0/zero_shot_hist/batch_2.xlsx").collect()
    assert [int(r["id"]) for r in got] == list(range(2, 60, 3)) and set(got[0].asDict()) == {"k", "id", "text"}
    assert spark.read.parquet(f"{tmp_path}/run/r0/zero_shot_hist/batch_1.parquet").count() == 20
    spreadsheets.write(rows, str(tmp_path / "run"), "to", ["id"])  # nothing is too large now
    assert not (tmp_path / "run/r0/zero_shot_hist/batch_1.parquet").exists()
    scan = batches.read_batches(spark, str(tmp_path / "run"))
    assert scan.count() == 60 and {(r["runner_name"], r["experiment_name"], r["source_file"]) for r in scan.collect()} == {("r0", "zero_shot_hist", f"batch_{i}.xlsx") for i in range(3)}


def test_a_text_too_long_for_a_cell_is_kept_whole(spark, tmp_path):
    spreadsheets.write(spark.createDataFrame([("y" * 40_000,)], "s string").coalesce(1), str(tmp_path / "o"))
    assert spark.read.parquet(f"{tmp_path}/o/part-00000.parquet").first()["s"] == "y" * 40_000


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(1000, numPartitions=4).select(F.when(F.col("id") == 999, F.raise_error("no")).otherwise(F.col("id").cast("string")).alias("s"))
    with pytest.raises(Exception, match="no"):
        spreadsheets.write(bad, str(tmp_path / "o"))
    assert [p for p in (tmp_path / "o").rglob("*") if p.is_file()] == []
    spreadsheets.write(spark.createDataFrame([], "s string"), str(tmp_path / "none"))
    assert [p for p in (tmp_path / "none").rglob("*.xlsx")] == []


def test_batches_of_all_formats_meet_by_name(spark, tmp_path):
    root = tmp_path / "in"
    at = spark.createDataFrame([("1", "x")], "patient_id string, only_here string").withColumn("to", F.lit("r1/e1/batch_0"))
    spreadsheets.write(at, str(root), "to")
    (root / "r1/e2").mkdir(parents=True)
    (root / "r1/e2/batch_0.csv").write_text("patient_id,other\n2,y\n")
    got = {r["patient_id"]: r for r in batches.read_batches(spark, str(root)).collect()}
    assert got["1"]["only_here"] == "x" and got["1"]["other"] is None and got["2"]["other"] == "y"
    assert (got["1"]["experiment_name"], got["1"]["runner_name"], got["1"]["source_file"]) == ("e1", "r1", "batch_0.xlsx")
