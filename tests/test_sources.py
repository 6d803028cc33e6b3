"""CSV, Parquet and the pipeline."""

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cohortpulse.plans import features
from cohortpulse.plans.clean import clean_attendance
from cohortpulse.plans.pipeline import export_csv, exported, run, with_summary, write_silver
from cohortpulse.plans.registry import clean_of
from cohortpulse.plans import audit
from cohortpulse.sources.files import read_bronze_csv, read_clean_csv, split_bronze_csv, write_bucketed, write_csv, write_parquet
from cohortpulse.sources.published import manifest, publish, published_nulls, published_paths
from cohortpulse.sources.fixtures import derived_tables
from cohortpulse.sources.schemas import BRONZE, EXPORTED, SILVER
from cohortpulse.sources.scratch import scratch_path, written
from tests.helpers import AS_OF, first_plan, rows


def test_csv_round_trip(spark, tmp_path):
    given = [
        ("S1", "HW-1", "Math", "2024-01-01", " Done ", "Yes", 'a "q", b'),
        (" S2 ", None, "Arabic", "01-02-2024", "✅", " ", None),
        ("S3", "x,y", None, None, "❌", None, "\\"),
        ("S4", "two\nlines\r\n", "a\\nb", "\\\\n", '"\n"', " x", "\n"),
    ]
    df = spark.createDataFrame(given, ", ".join(f"{c} string" for c in BRONZE["homework"]))
    write_csv(df, str(tmp_path / "hw.csv"))
    assert sorted(rows(read_bronze_csv(spark, str(tmp_path / "hw.csv"), "homework", encoded=True))) == sorted(given)
    assert spark.read.text(str(tmp_path / "hw.csv")).where("value NOT LIKE 'Student%'").count() == len(given)


def test_typed_csv_keeps_line_ends(spark, tmp_path):
    given = [("S1", "A\nB", "Grade 1", 1, 9), ("S\\2", None, "x\r", None, None)]
    write_csv(spark.createDataFrame(given, SILVER["students"]), str(tmp_path / "s.csv"))
    assert sorted(rows(read_clean_csv(spark, str(tmp_path / "s.csv"), "students"))) == sorted(given)


def test_ragged_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Student_ID,Date,Subject,Attendance_Status\nS1,2024-01-01\n")
    assert rows(read_bronze_csv(spark, str(tmp_path / "a.csv"), "attendance")) == [("S1", "2024-01-01", None, None)]
    (tmp_path / "b.csv").write_text("Student_ID,Date,Subject,Attendance_Status\nS1,d,Math,Late,more\n")
    with pytest.raises(Exception, match="more fields than the header"):
        read_bronze_csv(spark, str(tmp_path / "b.csv"), "attendance").select("Student_ID").collect()


def test_usual_texts_for_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Student_ID,Date,Subject,Attendance_Status\nNA,null,n/a,Late\n")
    path = str(tmp_path / "a.csv")
    assert rows(read_bronze_csv(spark, path, "attendance")) == [(None, None, None, "Late")]
    assert rows(read_bronze_csv(spark, path, "attendance", na_values=["Late"])) == [("NA", "null", "n/a", None)]


def test_derived_tables_read_whole_tables(spark, sf_dir):
    raw = derived_tables(spark, sf_dir)
    sources = {"students": "customer", "homework": "orders", "performance": "orders", "attendance": "lineitem"}
    for name, source in (sources | {"teacher_parent_communication": "events"}).items():
        assert raw[name].count() == spark.read.parquet(f"{sf_dir}/{source}.parquet").count()
    assert raw["teacher_parent_communication"].select(F.substring("Date", 1, 7)).distinct().count() >= 6


def test_csv_columns_are_taken_by_name(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "Extra,Grade_Level,Student_ID,Full_Name,Emergency_Contact,Date_of_Birth\n1,Grade 1, S1 ,n/a,,2015-01-01\n"
    )
    path = str(tmp_path / "s.csv")
    assert rows(read_bronze_csv(spark, path, "students", na_values=())) == [(" S1 ", "n/a", "Grade 1", "2015-01-01", None)]
    assert rows(read_bronze_csv(spark, path, "students"))[0][1] is None


def test_csv_without_a_column_is_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Student_ID,Date\nS1,2024-01-01\n")
    with pytest.raises(ValueError, match="Attendance_Status"):
        read_bronze_csv(spark, str(tmp_path / "a.csv"), "attendance")


def test_multiline_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Student_ID,Date,Message_Type,Message_Content\nS1,2024-01-01,x,"one\ntwo"\n')
    read = read_bronze_csv(spark, str(tmp_path / "c.csv"), "teacher_parent_communication", multiline=True)
    assert rows(read) == [("S1", "2024-01-01", "x", "one\ntwo")]


def test_partitioned_parquet_has_one_file_per_value_and_prunes(spark, tmp_path):
    df = spark.range(0, 1000, 1, 8).select(F.concat(F.lit("2024-0"), F.col("id") % 3 + 1).alias("Month"), "id")
    path = str(tmp_path / "facts")
    write_parquet(df, path, ["Month"])
    assert {p.name: len(list(p.glob("*.parquet"))) for p in Path(path).glob("Month=*")} == {
        f"Month=2024-0{m}": 1 for m in (1, 2, 3)
    }
    one = spark.read.parquet(path).filter("Month = '2024-02'")
    assert one.count() == 333
    assert "PartitionFilters: [isnotnull(Month" in first_plan(one)


def test_scratch_is_below_the_checkpoint_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    assert rows(written(spark.range(2), "x").orderBy("id")) == [(0,), (1,)]


def test_pipeline_from_csv_to_csv(spark, sf_dir, tmp_path):
    raw = derived_tables(spark, sf_dir)
    for name in BRONZE:
        write_csv(raw[name], f"{tmp_path}/raw/{name}.csv")
    run(spark, f"{tmp_path}/raw", f"{tmp_path}/out", AS_OF)
    expected = clean_of(spark, sf_dir)
    last = exported(spark, f"{tmp_path}/out")
    for name in EXPORTED:
        found = last[name]
        wanted = features.student_summary(expected) if name == "student_summary" else expected[name]
        assert found.columns == wanted.columns
        assert found.dtypes == wanted.dtypes
        assert sorted(rows(found), key=str) == sorted(rows(wanted), key=str), name


def test_silver_parquet_keeps_columns_and_types(spark, sf_dir, tmp_path):
    tables = clean_of(spark, sf_dir)
    silver = write_silver(tables, str(tmp_path))
    for name in ("attendance", "homework", "performance"):
        assert silver[name].dtypes == tables[name].dtypes
        assert sorted(rows(silver[name]), key=str) == sorted(rows(tables[name]), key=str)
    assert silver["attendance"].filter(F.col("Date") < date(1900, 1, 1)).count() == 0


def test_cleaning_runs_on_a_stream(spark, sf_dir, tmp_path):
    raw = derived_tables(spark, sf_dir)["attendance"]
    raw.write.parquet(str(tmp_path / "raw"))
    stream = clean_attendance(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "raw")))
    query = stream.writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(rows(spark.table("cleaned")), key=str) == sorted(rows(clean_of(spark, sf_dir)["attendance"]), key=str)


def test_a_failed_export_leaves_the_last_one_readable(spark, tmp_path):
    root = str(tmp_path / "out")
    assert manifest(spark, root).count() == 0
    with pytest.raises(FileNotFoundError):
        published_paths(spark, root)
    good = {name: spark.createDataFrame([(i, "x"), (i, None)], "i int, t string") for i, name in enumerate("abcde")}
    first = publish(good, root, write_csv, ".csv")
    broken = spark.range(10).select(F.raise_error(F.lit("no third output")).cast("string").alias("t"))
    with pytest.raises(Exception, match="no third output"):
        publish({**{n: good[n].limit(1) for n in "ab"}, "c": broken, "d": good["d"], "e": good["e"]}, root, write_csv, ".csv")
    paths = published_paths(spark, root)
    assert set(paths) == set(good) and all(first in p for p in paths.values())
    assert all(spark.read.option("header", True).csv(p).count() == 2 for p in paths.values())
    second = publish({n: df.limit(1) for n, df in good.items()}, root, write_csv, ".csv")
    assert second > first and {second} == {r["version"] for r in manifest(spark, root).collect()}
    assert all(spark.read.option("header", True).csv(p).count() == 1 for p in published_paths(spark, root).values())


def test_nulls_are_counted_while_outputs_are_written(spark, sf_dir, tmp_path):
    tables = clean_of(spark, sf_dir)
    export_csv(with_summary(tables), str(tmp_path))
    found = {tuple(r) for r in published_nulls(spark, str(tmp_path)).collect()}
    report = audit.quality_report(derived_tables(spark, sf_dir), tables).collect()
    assert found == {tuple(r) for r in report if r["table"] in EXPORTED} and found


def test_unreadable_rows_are_set_aside(spark, tmp_path):
    lines = ["Student_ID,Date,Subject,Attendance_Status", "S1,2024-01-01,Math,Late", "S2,d,Math,Late,more", "S3,d",
             'S4,d,"a,b",NA', 'S5,d,"x,y",Late,"1,2",3,4', ",,,", "S6,d,Math,Late,"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    readable, unreadable = split_bronze_csv(spark, str(tmp_path / "a.csv"), "attendance")
    assert sorted(rows(readable), key=str) == sorted(
        [("S1", "2024-01-01", "Math", "Late"), ("S3", "d", None, None), ("S4", "d", "a,b", None), (None,) * 4, ("S6", "d", "Math", "Late")],
        key=str,
    )
    found = unreadable.collect()
    assert {(r["key"], r["text"]) for r in found} == {("S2", lines[2]), ("S5", lines[5])}
    assert all(r["file"].endswith("a.csv") for r in found) and unreadable.count() == 2
    assert readable.select("Student_ID").where("Student_ID = 'S2'").count() == 0
    strict = read_bronze_csv(spark, str(tmp_path / "a.csv"), "attendance")
    with pytest.raises(Exception, match="more fields than the header"):
        strict.collect()


def test_a_hot_key_is_stored_without_buckets(spark, tmp_path):
    even = spark.range(400).select((F.col("id") % 50).alias("k"), "id")
    hot = spark.range(400).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"), "id")
    for name, df in (("stored_even", even), ("stored_hot", hot)):
        write_bucketed(df, name, "k", 16, str(tmp_path / name))
        assert sorted(rows(spark.table(name))) == sorted(rows(df))
        assert ("hashpartitioning(k" in first_plan(spark.table(name).groupBy("k").count())) == (name == "stored_hot")
        spark.sql(f"DROP TABLE {name}")
