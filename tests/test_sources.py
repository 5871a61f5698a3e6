"""Reading, writing, snapshots and checkpoints."""

import os
from datetime import datetime

import pytest
from helpers import T0, texts
from pyspark.sql import functions as F

from loglane.operators import aggregates as ag
from loglane.operators import ordered as od
from loglane.plans import lineage
from loglane.schema import as_logs, duration_micros
from loglane.sources import archive, combine, sinks, snapshots, text


def put(folder, name, body):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as f:
        f.write(body)
    return path


def test_read_logs_keeps_line_order(spark, tmp_path):
    a = str(tmp_path / "a")
    # Two files, one longer than a split, and one source that is a single file.
    many = [f"line {i} " + "x" * 300 for i in range(20_000)]
    put(a, "1.log", "\n".join(many) + "\n")
    put(a, "2.log", "last\r\n\nend")
    b = put(str(tmp_path / "b"), "b.log", "only é\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1MB")
    try:
        df = text.read_logs(spark, {"api": a, "db": b})
        rows = df.orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert df.rdd.getNumPartitions() >= 1
    assert [r["text"] for r in rows] == [*many, "last\r", "", "end", "only é"]
    assert len({r["seq"] for r in rows}) == len(rows)
    assert rows[0]["service"] == "api" and rows[-1]["service"] == "db" and rows[0]["ts"] is not None


def test_read_logs_checks(spark, tmp_path):
    for bad in ({}, {"": "x"}, {"a": ""}):
        with pytest.raises(ValueError):
            text.read_logs(spark, bad)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        text.read_logs(spark, {"a": str(tmp_path / "missing")})


def test_merge_and_label(logs):
    a, b = logs([("x", "1")]), logs([("y", "2"), ("y", "3")])
    assert combine.merge(a, b).count() == 3
    got = combine.label_all({"l": a, "r": b}).groupBy("service").count().collect()
    assert {tuple(r) for r in got} == {("l", 1), ("r", 2)}
    with pytest.raises(ValueError):
        combine.merge()
    with pytest.raises(ValueError):
        combine.label_all({})


def test_fan_out(logs):
    df = logs([("a", "1"), ("b", "2")])
    counts, seen = combine.fan_out(df, lambda d: d.count(), texts)
    assert counts == 2 and seen == ["1", "2"]
    with pytest.raises(ValueError):
        combine.fan_out(df)


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_snapshot_round_trip(spark, logs, tmp_path, fmt):
    path = str(tmp_path / "snap")
    at = datetime(2024, 5, 1)
    snapshots.save_snapshot(logs([("api", 'a "q"\n'), (None, "b")]), path, fmt, created_at=at)
    rows = snapshots.load_snapshot(spark, path, fmt).orderBy("line").collect()
    assert [(r["service"], r["line"]) for r in rows] == [("api", 'a "q"\n'), (None, "b")]
    assert rows[0]["captured_at"] == T0 and rows[0]["created_at"] == at
    assert snapshots.snapshot_logs(snapshots.load_snapshot(spark, path, fmt)).columns == ["service", "text", "ts"]


def test_snapshot_errors(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        snapshots.load_snapshot(spark, str(tmp_path / "none"))
    bad = str(tmp_path / "bad")
    put(bad, "x.json", "{not json\n")
    with pytest.raises(Exception, match="MALFORMED"):
        snapshots.load_snapshot(spark, bad).collect()


def test_checkpoint(spark, tmp_path):
    path = str(tmp_path / "cp")
    assert snapshots.load_checkpoint(spark, path).count() == 0
    update = lambda *rows: spark.createDataFrame(list(rows), "service string, offset bigint")
    one = snapshots.set_offsets(snapshots.empty_checkpoint(spark), update(("a", 10), ("b", 5)))
    snapshots.save_checkpoint(one, path, 1)
    two = snapshots.set_offsets(snapshots.load_checkpoint(spark, path), update(("a", 3)))
    snapshots.save_checkpoint(two, path, 2)
    newest = snapshots.load_checkpoint(spark, path)
    assert {(r["service"], r["offset"]) for r in newest.collect()} == {("a", 3), ("b", 5)}
    assert snapshots.get_offset(newest, "a") == 3 and snapshots.get_offset(newest, "zzz") == 0
    for bad in (("", 1), (None, 1), ("a", -1)):
        with pytest.raises(Exception, match="checkpoint:"):
            snapshots.set_offsets(one, update(bad)).collect()
    # What an interrupted writer leaves does not count, and may be written again; a complete version may not.
    put(path + "/version=3", "x.json", '{"service":"c","offset":7}\n')
    assert {r["service"] for r in snapshots.load_checkpoint(spark, path).collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="not complete"):
        snapshots.load_checkpoint(spark, path, 3)
    with pytest.raises(ValueError, match="already"):
        snapshots.save_checkpoint(one, path, 2)
    snapshots.save_checkpoint(one, path, 3)
    assert {(r["service"], r["offset"]) for r in snapshots.load_checkpoint(spark, path).collect()} == {("a", 10), ("b", 5)}
    # Entries that were added or lost after the note was written.
    put(path + "/version=3", "y.json", '{"service":"z","offset":1}\n')
    with pytest.raises(ValueError, match="entries"):
        snapshots.load_checkpoint(spark, path)
    snapshots.save_checkpoint(snapshots.empty_checkpoint(spark), path, 4)
    assert snapshots.load_checkpoint(spark, path).count() == 0
    put(path + "/version=5", "x.json", '{"service":"","offset":1}\n{"service":"c","offset":7}\n')
    put(path + "/complete", "x.json", '{"version":5,"entries":2}\n')
    assert [r["service"] for r in snapshots.load_checkpoint(spark, path).collect()] == ["c"]


def test_resume(spark, logs):
    df = logs([("a", "12345"), ("b", "x"), ("a", "678"), ("a", "9")])
    stored = spark.createDataFrame([("a", 6, T0)], snapshots.CHECKPOINT_SCHEMA)
    assert texts(snapshots.resume(df, stored)) == ["x", "678", "9"]


def test_archive_opens_only_files_that_are_wanted(spark, logs, tmp_path):
    path = str(tmp_path / "archive")
    first = logs([(s, f"{s}{i}") for i in range(300) for s in "ab"])
    second = logs([("a", "later"), ("c", None), ("c", "é")])
    with pytest.raises(ValueError):
        archive.append_lines(first, path, -1)
    archive.append_lines(first, path, 0)
    archive.append_lines(second, path, 1)
    # Again, as after a failure: nothing is there twice.
    archive.append_lines(second, path, 1)
    ends = {r["service"]: r["offset"] for r in od.final_offsets(first).collect()}
    whole = archive.resume_lines(spark, path, snapshots.empty_checkpoint(spark))
    assert whole.count() == 603
    stored = spark.createDataFrame([("a", ends["a"], T0), ("b", ends["b"] - 9, T0)], snapshots.CHECKPOINT_SCHEMA)
    rest = archive.resume_lines(spark, path, stored)
    assert sorted(((r["service"], r["text"], r["offset"]) for r in rest.collect()), key=repr) == [
        ("a", "later", ends["a"]), ("b", "b299", ends["b"] - 5), ("c", "é", 1), ("c", None, 0)
    ]
    # Files that end before the stored offset are not in the scan, and nothing is sorted to find out.
    stored = spark.createDataFrame([("a", ends["a"], T0), ("b", ends["b"], T0)], snapshots.CHECKPOINT_SCHEMA)
    rest = archive.resume_lines(spark, path, stored)
    assert rest.count() == 3 and all("round=1" in f for f in rest.inputFiles())
    assert "Window" not in rest._jdf.queryExecution().optimizedPlan().toString()
    done = spark.createDataFrame([("a", 10**6, T0), ("b", 10**6, T0), ("c", 10**6, T0)], snapshots.CHECKPOINT_SCHEMA)
    assert archive.resume_lines(spark, path, done).collect() == []
    with pytest.raises(ValueError):
        archive.resume_lines(spark, str(tmp_path / "none"), done)


def test_buckets_and_lines(spark, logs, tmp_path):
    df = logs([("s", "ERROR x"), ("s", "ok"), ("s", "drop")])
    out = str(tmp_path / "out")
    sinks.write_buckets(df, [("errors", "ERROR"), ("no", "drop")], out, "rest", wanted=["errors", "rest"])
    assert sorted(d for d in os.listdir(out) if "=" in d) == ["bucket=errors", "bucket=rest"]
    sinks.write_rendered(df, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 3


def test_as_logs_and_durations(spark):
    df = spark.createDataFrame([(1, "a", "b", T0, 9)], "n int, s string, t string, at timestamp, extra int")
    out = as_logs(df, seq="n", service="s", text=F.upper("t"), ts="at", keep=("extra",))
    assert out.columns == ["seq", "service", "text", "ts", "extra"] and out.first()["text"] == "B"
    assert od.head(out, 1).columns == out.columns
    assert duration_micros("90 seconds") == duration_micros(90) == 90_000_000
    with pytest.raises(ValueError):
        duration_micros("later")


def test_checkpoint_folder_comes_from_the_session(spark):
    assert lineage.cut(spark.range(3)).count() == 3
    assert spark.sparkContext.getCheckpointDir()


def test_time_with_zone_works_too(logs):
    df = logs([("s", "a", 0), ("s", "a", 1), ("s", "b", 9)]).withColumn("ts", F.col("ts").cast("timestamp"))
    assert texts(od.debounce(df, 5)) == ["a", "b"]
    assert [r["count"] for r in ag.rolling_count(df, 5).orderBy("seq").collect()] == [1, 2, 1]


def test_read_logs_numbers_are_unique_for_any_split(spark, tmp_path):
    many = [f"{i}" if i % 3 else "" for i in range(60_000)]
    put(str(tmp_path / "a"), "1.log", "\n".join(many))
    put(str(tmp_path / "a"), "2.log", "\n" * 50)
    confs = {"openCostInBytes": "1000", "minPartitionNum": "64", "maxPartitionBytes": "4000"}
    for k, x in confs.items():
        spark.conf.set(f"spark.sql.files.{k}", x)
    try:
        rows = text.read_logs(spark, {"s": str(tmp_path / "a")}).orderBy("seq").collect()
    finally:
        for k in confs:
            spark.conf.unset(f"spark.sql.files.{k}")
    assert [r["text"] for r in rows] == many + [""] * 50
    assert len({r["seq"] for r in rows}) == len(rows)


def test_small_tables_are_measured_without_one_task(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 1000) AS text")
    plan = lambda d: d._jdf.queryExecution().toString()
    assert "broadcast" in plan(lineage.broadcast_if_small(df))
    assert "broadcast" not in plan(lineage.broadcast_if_small(df, 50_000))


def test_limits_before_the_shuffle(logs):
    df = od.head(logs([("a", "1"), ("b", "2"), ("a", "3")]), 1)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert texts(df) == ["1", "2"]


def test_pace_of_a_very_long_stream(spark, logs):
    df = logs([("a", "x"), ("a", "y")])
    _, state = od._pace(df, 1, None)
    rows = state["rows"].withColumn("__n", F.lit(10**10).cast("bigint"))
    out = od._pace(df, 1, None, {"rows": rows})[0].collect()
    assert len(out) == 2 and all(r["paced_ts"] is not None for r in out)
