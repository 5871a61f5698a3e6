"""Streams in several batches give what the whole table gives; a batch run again changes nothing."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loglane.operators import aggregates as ag
from loglane.operators import drift as dr
from loglane.operators import grouping as gr
from loglane.operators import ordered as od
from loglane.sources import snapshots, text
from loglane.streaming import stateful, steps, windows
from test_ordered import random_lines, table


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A table as three files, each one micro-batch, and the table itself."""
    lines = random_lines(11, 75)
    folder = str(tmp_path_factory.mktemp("stream"))
    for i in range(3):
        name = os.path.join(folder, f"part{i}")
        table(spark, lines[i * 25 : (i + 1) * 25]).coalesce(1).write.parquet(name)
        file = next(f for f in os.listdir(name) if f.endswith(".parquet"))
        target = os.path.join(folder, f"{i}.parquet")
        os.link(os.path.join(name, file), target)
        # The file source takes files by age.
        os.utime(target, (1_700_000_000 + i * 100,) * 2)
    return folder, table(spark, lines).cache()


def read(spark, parts, per_batch=1):
    folder, df = parts
    reader = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch)
    return reader.parquet(f"{folder}/*.parquet")


def run(spark, parts, step, base):
    query = stateful.run(
        read(spark, parts), step.step, output=f"{base}/out", state=f"{base}/state", checkpoint=f"{base}/cp", names=step.names
    )
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("batch")
    if step.end:
        out = out.unionByName(stateful.finish(spark, step.end, state=f"{base}/state", names=step.names))
    return out


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


CASES = {
    "head": (steps.head(5), lambda d: od.head(d, 5)),
    "sample": (steps.sample_overall(3), lambda d: od.sample_overall(d, 3)),
    "gate": (steps.gate("START", "x"), lambda d: od.gate(d, "START", "x")),
    "dedupe": (steps.dedupe(), od.dedupe),
    "suppress": (steps.suppress(2), lambda d: od.suppress(d, 2)),
    "debounce": (steps.debounce(2.0), lambda d: od.debounce(d, 2.0)),
    "byte_offset": (steps.byte_offset(), od.with_byte_offset),
    "line_number": (steps.line_number(), od.line_number),
    "sequence": (steps.sequence(), od.sequence),
    "pace": (steps.pace(1), lambda d: od.pace(d, 1)),
    "service_index": (steps.service_index(), od.with_service_index),
    "join_runs": (steps.join_runs("+", 3), lambda d: gr.join_runs(d, "+", 3)),
    "multiline": (steps.multiline("START", 3.0), lambda d: gr.multiline(d, "START", 3.0)),
    "batches": (steps.batches(7), lambda d: gr.batches(d, 7)),
    "timed_batches": (steps.batches(7, 3.0), lambda d: gr.batches(d, 7, 3.0)),
    "reorder": (
        steps.reorder(4.0, lambda t: F.timestamp_seconds(F.length(t))),
        lambda d: od.reorder(d, 4.0, lambda t: F.timestamp_seconds(F.length(t))),
    ),
    "drift": (steps.drift(), dr.drift),
    "fuzzy": (steps.drift("fuzzy", 0.6), lambda d: dr.drift(d, "fuzzy", 0.6)),
}


@pytest.mark.parametrize("name", CASES)
def test_batches_equal_the_whole(spark, parts, tmp_path, name):
    step, whole = CASES[name]
    assert rows(run(spark, parts, step, str(tmp_path))) == rows(whole(parts[1]))


def test_multiline_per_service(spark, parts, tmp_path):
    step = steps.multiline("START", 3.0, per_service=True)
    want = gr.multiline(parts[1], "START", 3.0, per_service=True)
    assert rows(run(spark, parts, step, str(tmp_path))) == rows(want)


def test_last_n(spark, parts, tmp_path):
    step = steps.last_n(4)
    base = str(tmp_path)
    stateful.run(
        read(spark, parts), step.step, output=f"{base}/out", state=f"{base}/state", checkpoint=f"{base}/cp", names=step.names
    ).awaitTermination()
    newest = spark.read.parquet(f"{base}/out").filter("batch = 2").drop("batch")
    assert rows(newest) == rows(od.last_n(parts[1], 4))


def test_a_batch_run_again_changes_nothing(spark, parts, tmp_path):
    """The commit of the last batch is lost, as after a crash, and the query starts again."""
    base, step = str(tmp_path), steps.drift()
    first = rows(run(spark, parts, step, base))
    for name in ("2", ".2.crc"):
        os.remove(os.path.join(base, "cp", "commits", name))
    assert rows(run(spark, parts, step, base)) == first


def append(df, base):
    query = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
    query.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{base}/out")


def test_window_counts(spark, parts, tmp_path):
    got = append(windows.window_counts(read(spark, parts), "5 seconds", "1 second"), str(tmp_path))
    end = parts[1].agg(F.max(F.col("ts").cast("timestamp")) - F.expr("INTERVAL 1 SECOND")).first()[0]
    want = ag.window_counts(parts[1].withColumn("ts", F.col("ts").cast("timestamp")), "5 seconds")
    assert rows(got) == rows(want.filter(F.col("window_end") <= F.lit(end)))


def test_bursts(spark, parts, tmp_path):
    got = append(windows.coalesce_bursts(read(spark, parts), 2.0, 0), str(tmp_path))
    want = gr.coalesce_bursts(parts[1].withColumn("ts", F.col("ts").cast("timestamp")), 2.0)
    # The last bursts are still open when the stream ends.
    assert set(rows(got)) <= set(rows(want)) and got.count() >= want.count() - 5


def test_rolling_and_alert_counts(spark, parts, tmp_path):
    got = append(windows.rolling_counts(read(spark, parts), 4, 2, 0), str(tmp_path / "a"))
    assert got.count() > 0 and got.columns == ["service", "count", "window_end"]
    got = append(windows.alert_counts(read(spark, parts), [("x", "x")], 4, 0), str(tmp_path / "b"))
    assert {r["rule"] for r in got.collect()} == {"x"}


def test_line_counts_and_top(spark, parts, tmp_path):
    query = windows.line_counts(read(spark, parts)).writeStream.format("memory").queryName("line_counts_t")
    query.outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("line_counts_t")) == rows(ag.line_counts(parts[1]))
    base = str(tmp_path)
    windows.top_lines(read(spark, parts), 2, output=f"{base}/out", checkpoint=f"{base}/cp").awaitTermination()
    newest = spark.read.parquet(f"{base}/out").filter("batch = 2").drop("batch")
    assert rows(newest) == rows(ag.top_lines(parts[1], 2))


def test_text_stream_is_numbered_and_captured(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    for i in range(3):
        p = folder / f"{i}.log"
        p.write_text("".join(f"line {i}.{j}\n" for j in range(4)))
        os.utime(p, (1_700_000_000 + i * 100,) * 2)
    stream = text.stream_logs(spark, {"api": str(folder)}, max_files_per_trigger=1)
    base = str(tmp_path)
    step = steps.sequence()
    stateful.run(
        stream, step.step, output=f"{base}/out", state=f"{base}/state", checkpoint=f"{base}/cp", names=step.names
    ).awaitTermination()
    out = spark.read.parquet(f"{base}/out").orderBy("seq").collect()
    assert [r["seq"] for r in out] == list(range(1, 13))
    assert [r["text"] for r in out] == [f"line {i}.{j} [#{i * 4 + j + 1}]" for i in range(3) for j in range(4)]
    snapshots.stream_snapshot(stream, f"{base}/snap", f"{base}/snapcp").awaitTermination()
    assert snapshots.load_snapshot(spark, f"{base}/snap").count() == 12
    later = text.stream_logs(spark, {"api": str(folder)}, start=datetime(2023, 11, 14, 22, 15, 0))
    snapshots.stream_snapshot(later, f"{base}/snap2", f"{base}/snap2cp").awaitTermination()
    assert snapshots.load_snapshot(spark, f"{base}/snap2").count() == 8


def test_a_registered_stream_reads_its_view_a_fixed_number_of_times(spark, tmp_path, monkeypatch):
    from loglane.plans import catalog

    monkeypatch.setattr(catalog, "BATCH_LINES", 10)
    monkeypatch.setattr(catalog, "scratch", lambda s: str(tmp_path))
    read = spark.sparkContext.accumulator(0)

    def copy(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    rows = spark.createDataFrame([(i * 7 % 101, "s", f"t{i}", None) for i in range(101)], "seq long, service string, text string, ts timestamp")
    view = lambda s, f: rows.mapInPandas(copy, rows.schema)
    assert catalog._stream(spark, "", view).isStreaming
    assert read.value <= 3 * 101
    files = sorted((os.stat(f).st_mtime_ns, str(f)) for f in (tmp_path / "source").glob("*.parquet"))
    parts = [sorted(r["seq"] for r in spark.read.parquet(f).collect()) for _, f in files]
    assert len(parts) == 11 and sum(parts, []) == list(range(101)) and max(map(len, parts)) < 20


def test_a_batch_without_new_forms_starts_no_search(spark, monkeypatch):
    def search(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(dr, "fuzzy_firsts", search)
    lines = spark.createDataFrame([(5, "a", "one"), (6, "a", "two")], "seq long, service string, text string")
    seen = spark.createDataFrame([("one", 1), ("two", 2)], "norm string, first_seq long")
    step = steps.drift("fuzzy", 0.8)
    out, state = step.step(lines, {"seen": seen})
    assert [r["drift"] for r in out.collect()] == [False, False] and state["seen"].count() == 0
