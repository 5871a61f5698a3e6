"""Operators that put several lines into one: runs, multi-line records, bursts, batches."""

from __future__ import annotations

from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglane.functions.regex import matches, translate
from loglane.operators.ordered import ARRIVAL, TIME, _at_least, _positive
from loglane.plans.chunks import (
    CHUNK,
    Carry,
    add_chunks,
    carry,
    clean,
    keys_of,
    local,
    with_position,
    with_runs,
)
from loglane.schema import duration_micros, micros, require


def _joined(order: Column, text: Column, sep: str) -> Column:
    """Aggregate: texts in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    return F.array_join(F.transform(parts, lambda p: p["t"]), sep)


def run_blocks(df: DataFrame, max_lines: int, chunks: int | None = None) -> DataFrame:
    """Add ``__block`` and ``__pos``: blocks of at most ``max_lines`` lines inside each run."""

    # A run with an empty service name does not end when the service changes.
    def changes(prev: Column, service: Column) -> Column:
        return ~prev.eqNullSafe(service) & ~prev.eqNullSafe(F.lit(""))

    df, _ = with_runs(df, ARRIVAL, None, "service", changes, chunks=chunks)
    place = F.col("__pos") - F.col("__start")
    return df.withColumn("__block", F.col("__pos") - place % max_lines)


def join_blocks(df: DataFrame, sep: str) -> DataFrame:
    """One line per block, which holds few lines, so that no group is large."""
    columns = [c for c in df.columns if not c.startswith("__")]
    last = F.max_by(F.struct(*[c for c in columns if c != "text"]), F.col("seq")).alias("__last")
    out = df.groupBy("__block").agg(_joined(F.col("seq"), F.col("text"), sep).alias("text"), last)
    return out.select("__last.*", "text").select(*columns)


def join_runs(df: DataFrame, sep: str, max_lines: int, *, chunks: int | None = None) -> DataFrame:
    """Join consecutive lines of one service, at most ``max_lines`` at a time.

    The other columns come from the last line joined.
    """
    if not sep:
        raise ValueError("join_runs: separator must not be empty")
    require(df, "seq", "service", "text")
    return join_blocks(run_blocks(df, _at_least("max_lines", max_lines, 2), chunks), sep)


def records(
    df: DataFrame, start: str, timeout_us: int, group: str | None, chunks: int | None = None
) -> DataFrame:
    """Add ``__rec`` (``seq`` of the start line, -1 if none), ``__late``, and the record's header."""
    df = add_chunks(df, ARRIVAL, chunks).withColumn("__us", micros(df))
    df = df.withColumn("__is_start", matches(F.col("text"), start))
    header = F.struct("seq", "service", "ts", F.col("__us").alias("us"))
    start_seq = F.when(F.col("__is_start"), F.col("seq"))
    df, _ = carry(
        df,
        group,
        [
            Carry("__open", F.max_by(header, start_seq), "last"),
            Carry("__first", F.min_by(header, F.col("seq")), "first"),
        ],
    )
    w = local(group, ARRIVAL).rowsBetween(Window.unboundedPreceding, 0)
    # The start line of the record a line belongs to, or the very first line if there was none.
    started = F.last(F.when(F.col("__is_start"), header), ignorenulls=True).over(w)
    df = df.withColumn("__head", F.coalesce(started, F.col("__open")))
    df = df.withColumn("__first", F.coalesce(F.col("__first"), F.first(header).over(w)))
    opened = F.coalesce(F.col("__head.us"), F.col("__first.us"))
    service = F.col("service") if group else F.coalesce(F.col("__head.service"), F.lit(""))
    if not group:
        service = F.when(F.col("__head").isNull(), F.lit("")).otherwise(F.col("__head.service"))
    return (
        df.withColumn("__rec", F.coalesce(F.col("__head.seq"), F.lit(-1).cast("bigint")))
        .withColumn("__late", F.col("__us") >= opened + timeout_us)
        .withColumn("__svc", service)
        .withColumn("__ts", F.coalesce(F.col("__head.ts"), F.col("__first.ts")))
    )


def join_records(df: DataFrame, group: str | None) -> DataFrame:
    """One line per record. Lines are joined inside each chunk first: a record that spans many
    chunks is built by many tasks, and only its pieces meet at the end."""
    columns = [c for c in df.columns if not c.startswith("__")]
    rest = [c for c in columns if c not in ("seq", "service", "ts", "text")]
    keys = keys_of(group)
    text = _joined(F.col("seq"), F.col("text"), "\n").alias("text")
    about = F.struct(F.col("__svc").alias("service"), F.col("__ts").alias("ts"), *rest)
    pieces = df.groupBy(*keys, CHUNK, "__rec", "__late").agg(
        text, F.min_by(about, F.col("seq")).alias("about"), F.min("seq").alias("seq")
    )
    out = pieces.groupBy(*keys, "__rec", "__late").agg(
        text, F.min_by("about", "seq").alias("about"), F.min("seq").alias("seq")
    )
    return out.select("seq", "text", "about.*").select(*columns)


def multiline(
    df: DataFrame,
    start: str,
    timeout: timedelta | float | str = 2.0,
    *,
    per_service: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """Join continuation lines to the line that matches ``start``.

    Service and time come from the start line; lines before the first start form a record with an
    empty service. Lines ``timeout`` or more after the start line form a second record. By default
    one buffer serves all services, as records of a merged stream are read; ``per_service`` keeps
    one for each.
    """
    translate(start)
    require(df, "seq", "service", "text", "ts")
    us = duration_micros(timeout, "timeout")
    us = us if us > 0 else 2_000_000
    group = "service" if per_service else None
    return join_records(records(df, start, us, group, chunks), group)


def coalesce_bursts(
    df: DataFrame, window: timedelta | float | str, *, sep: str = " | ", chunks: int | None = None
) -> DataFrame:
    """Join the lines of a service until it is quiet for more than ``window``.

    Gives ``seq, service, text, ts`` with ``seq`` and ``ts`` of the first line of the burst.
    """
    require(df, "seq", "service", "text", "ts")
    us = _positive("window", window)
    df = df.withColumn("__us", micros(df))
    quiet = lambda prev, at: at - prev > us
    df, _ = with_runs(df, TIME, "service", "__us", quiet, chunks=chunks)
    keys = ["service", "__start"]
    first = F.min_by(F.struct("seq", "ts"), F.col("__pos")).alias("first")
    # Pieces inside a chunk first (no further shuffle), then the pieces of each burst.
    pieces = df.groupBy(*keys_of("service"), "service", CHUNK, "__start").agg(
        F.min("__pos").alias("__pos"), _joined(F.col("__pos"), F.col("text"), sep).alias("text"), first
    )
    out = pieces.groupBy(*keys).agg(
        _joined(F.col("__pos"), F.col("text"), sep).alias("text"),
        F.min_by("first", "__pos").alias("first"),
    )
    return out.select(F.col("first.seq").alias("seq"), "service", "text", F.col("first.ts").alias("ts"))


def collect_batches(df: DataFrame, batch: Column) -> DataFrame:
    line = F.struct(*[c for c in ("seq", "service", "text", "ts") if c in df.columns])
    lines = F.array_sort(F.collect_list(line)).alias("lines")
    return df.groupBy(batch.cast("bigint").alias("batch_id")).agg(lines)


def with_batch(
    df: DataFrame,
    size: int,
    interval: timedelta | float | str | None = None,
    *,
    chunks: int | None = None,
    block_rows: int = 200_000,
) -> DataFrame:
    """Add ``batch_start``: the position of the first line of the batch a line falls in."""
    require(df, "seq")
    _at_least("size", size, 1)
    if interval is None:
        df, _ = with_position(df, ARRIVAL, chunks=chunks)
        start = F.col("__pos") - (F.col("__pos") - 1) % size
        return clean(df.withColumn("batch_start", start))
    require(df, "ts")
    return _timed_batches(df, size, _positive("interval", interval), chunks, block_rows)


def batches(
    df: DataFrame,
    size: int,
    interval: timedelta | float | str | None = None,
    *,
    chunks: int | None = None,
    block_rows: int = 200_000,
) -> DataFrame:
    """Arrays of at most ``size`` lines in arrival order: ``batch_id, lines``.

    With ``interval`` a batch also ends that long after its first line. ``batch_id`` is the
    position of the batch's first line.
    """
    df = with_batch(df, size, interval, chunks=chunks, block_rows=block_rows)
    return collect_batches(df, F.col("batch_start"))


def _timed_batches(df: DataFrame, size: int, interval_us: int, chunks: int | None, block_rows: int) -> DataFrame:
    """Batches cut by size and time, block by block.

    Where a batch ends depends on its first line, so blocks cannot simply be summed up. But what
    happens in a block depends on one thing only: which line opened the batch that is still open
    when the block begins, and that is one of the ``size`` lines before it. So

    1. each block, with those lines, tells for each such line which line opens the batch left
       open at its own end (``exits``);
    2. these answers are chained: inside groups of blocks, over the groups, and back down;
    3. each block, now knowing the line that applies, marks its own lines.

    No task sees more than a block and ``size`` lines, or the answers of one group of blocks.
    """
    block_rows = max(block_rows, size)
    df, _ = with_position(df.withColumn("__us", micros(df)), ARRIVAL, chunks=chunks)
    df = clean(df, "__pos", "__us").withColumn("__block", F.expr(f"(__pos - 1) div {block_rows}"))
    views = F.array(
        F.struct(F.col("__block").alias("block")),
        F.when(
            F.col("__pos") > (F.col("__block") + 1) * block_rows - size,
            F.struct((F.col("__block") + 1).alias("block")),
        ),
    )
    views = F.filter(views, lambda v: v.isNotNull())
    seen = df.select(F.inline(views), F.col("__pos").alias("pos"), F.col("__us").alias("us"))

    def exits(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        block = int(rows["block"].iloc[0])
        first = block * block_rows + 1
        pos, step = rows["pos"].to_numpy(), batch_step(rows["us"].to_numpy(), size, interval_us)
        if pos[-1] < first:
            # Nothing follows the last full block.
            return pd.DataFrame({"block": [], "entry": [], "exit": []}, dtype="int64")
        entries = range(int((pos < first).sum())) if block else [0]
        found: dict[int, int] = {}
        answers = []
        for entry in entries:
            path, at = [], entry
            while at not in found:
                path.append(at)
                after = step(at)
                if after >= len(pos):
                    found[at] = at
                    break
                at = after
            for p in path:
                found[p] = found[at]
            # A line whose batch ends before the block begins cannot have left one open.
            if not block or step(entry) >= len(pos) or pos[step(entry)] >= first:
                answers.append((block, int(pos[entry]) if block else 0, int(pos[found[entry]])))
        return pd.DataFrame(answers, columns=["block", "entry", "exit"])

    schema = "block bigint, entry bigint, exit bigint"
    answers = seen.groupBy("block").applyInPandas(exits, schema)
    # About as many groups as blocks in a group.
    rows = df.agg(F.max("__block").alias("b")).first()["b"] or 0
    width = max(2, int((rows + 1) ** 0.5) + 1)
    answers = answers.withColumn("group", F.expr(f"block div {width}"))

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        tables = [dict(zip(t["entry"], t["exit"])) for _, t in rows.sort_values("block").groupby("block")]
        out = []
        for entry in tables[0]:
            at = entry
            for table in tables:
                at = table.get(at, -1)
            out.append((int(rows["group"].iloc[0]), int(entry), int(at)))
        return pd.DataFrame([o for o in out if o[2] >= 0], columns=["group", "entry", "exit"])

    def entries(key: str):
        def walk(rows: pd.DataFrame) -> pd.DataFrame:
            at, out = int(rows["start"].iloc[0]), []
            for number, t in rows.sort_values(key).groupby(key):
                out.append((int(number), at))
                at = int(t.loc[t["entry"] == at, "exit"].iloc[0])
            return pd.DataFrame(out, columns=[key, "start"])

        return walk

    grouped = answers.groupBy("group").applyInPandas(chain, "group bigint, entry bigint, exit bigint")
    # One task for the few groups, then one per group for its blocks.
    tops = grouped.withColumn("start", F.lit(0).cast("bigint"))
    tops = tops.groupBy().applyInPandas(entries("group"), "group bigint, start bigint")
    known = answers.join(tops, "group").groupBy("group").applyInPandas(entries("block"), "block bigint, start bigint")
    known = known.withColumnRenamed("block", "__block").withColumnRenamed("start", "__entry")

    tail = seen.join(known.withColumnRenamed("__block", "block"), "block").filter(F.col("pos") == F.col("__entry"))
    known = known.join(
        tail.select(F.col("block").alias("__block"), F.col("us").alias("__entry_us")), "__block", "left"
    )

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by("__pos")
        pos, us = table["__pos"].to_numpy(), table["__us"].to_numpy()
        entry = table["__entry"][0].as_py()
        starts, at = pos.copy(), 0
        if entry:
            # The batch that was open already, as if its first line stood before the block.
            room = size - (int(pos[0]) - entry)
            hit = np.flatnonzero(us[:room] >= table["__entry_us"][0].as_py() + interval_us)
            at = int(hit[0]) if len(hit) else min(room, len(pos))
            starts[:at] = entry
        step = batch_step(us, size, interval_us)
        while at < len(pos):
            after = min(step(at), len(pos))
            starts[at:after] = pos[at]
            at = after
        return table.append_column("batch_start", pa.array(starts, pa.int64()))

    rows = df.join(known, "__block", "left")
    schema = T.StructType([*rows.schema.fields, T.StructField("batch_start", T.LongType())])
    return clean(rows.groupBy("__block").applyInArrow(mark, schema))


def batch_step(us: np.ndarray, size: int, interval_us: int):
    """Index of the line that opens the next batch, given the index of one that opens a batch."""
    if len(us) and (np.diff(us) >= 0).all():
        by_time = np.searchsorted(us, us + interval_us, side="left")
        return lambda i: int(min(i + size, by_time[i])) if by_time[i] < len(us) else i + size

    def step(i: int) -> int:
        hit = np.flatnonzero(us[i + 1 : i + size] >= us[i] + interval_us)
        return i + 1 + int(hit[0]) if len(hit) else i + size

    return step
