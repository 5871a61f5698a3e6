"""Order-dependent operators as steps for ``stateful.run``: ``step, names[, end]``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglane.operators import drift as dr
from loglane.operators import grouping as gr
from loglane.operators import ordered as od
from loglane.plans.chunks import clean
from loglane.plans.lineage import cut
from loglane.schema import duration_micros


@dataclass(frozen=True)
class StreamStep:
    step: Callable
    names: list[str]
    end: Callable | None = None


def head(n: int) -> StreamStep:
    return StreamStep(lambda df, st: od._head(df, n, st), ["rows"])


def sample_per_service(n: int) -> StreamStep:
    return StreamStep(lambda df, st: od._sample(df, n, "service", st), ["rows"])


def sample_overall(n: int) -> StreamStep:
    return StreamStep(lambda df, st: od._sample(df, n, None, st), ["rows"])


def gate(opens: str, closes: str | None = None, *, initially_open: bool = False, per_service: bool = False) -> StreamStep:
    group = "service" if per_service else None
    return StreamStep(lambda df, st: od._gate(df, opens, closes, initially_open, group, st), ["turns"])


def dedupe() -> StreamStep:
    return StreamStep(od._dedupe, ["rows"])


def suppress(max_reps: int) -> StreamStep:
    return StreamStep(lambda df, st: od._suppress(df, max_reps, st), ["rows"])


def debounce(window) -> StreamStep:
    us = duration_micros(window)
    return StreamStep(lambda df, st: od._debounce(df, us, st), ["rows"])


def byte_offset() -> StreamStep:
    return StreamStep(od._byte_offset, ["rows"])


def line_number(padding: int = 4) -> StreamStep:
    return StreamStep(lambda df, st: od._line_number(df, padding, st), ["rows"])


def sequence(prefix: str = "#") -> StreamStep:
    return StreamStep(lambda df, st: od._sequence(df, prefix, st), ["rows"])


def pace(lines_per_second: int, *, per_service: bool = False) -> StreamStep:
    group = "service" if per_service else None
    return StreamStep(lambda df, st: od._pace(df, lines_per_second, group, st), ["rows"])


def service_index() -> StreamStep:
    def step(df, st):
        order = od.service_order(df, st.get("order"))
        return od.with_service_index(df, order), {"order": order}

    return StreamStep(step, ["order"])


def last_n(n: int = 100) -> StreamStep:
    """Each batch's output is the whole of the last ``n`` lines so far."""

    def step(df, st):
        out = od.last_n(_with_held(df, st), n)
        return out, {"held": out}

    return StreamStep(step, ["held"])


def _with_held(df: DataFrame, st: dict) -> DataFrame:
    return df.unionByName(st["held"]) if "held" in st else df


def join_runs(sep: str, max_lines: int) -> StreamStep:
    """Lines of a block that the next batch may still extend are held back."""

    def step(df, st):
        df = cut(gr.run_blocks(_with_held(df, st), max_lines))
        last, pos = df.agg(F.max("__block"), F.max("__pos")).first()
        open_block = (F.col("__block") == last) & F.lit((pos or 0) - (last or 0) + 1 < max_lines)
        return gr.join_blocks(df.filter(~open_block), sep), {"held": clean(df.filter(open_block))}

    return StreamStep(step, ["held"], lambda st: gr.join_runs(st["held"], sep, max_lines))


def multiline(start: str, timeout=2.0, *, per_service: bool = False) -> StreamStep:
    """Lines of the record that is still open are held back."""
    us = duration_micros(timeout)
    us = us if us > 0 else 2_000_000
    group = "service" if per_service else None

    def step(df, st):
        df = cut(gr.records(_with_held(df, st), start, us, group))
        keys = ["__group", "__group_null"] if group else []
        newest = df.groupBy(*keys).agg(F.max("__rec").alias("__newest"))
        if group:
            df = df.join(newest, keys)
        else:
            df = df.withColumn("__newest", newest.scalar())
        is_open = F.col("__rec") == F.col("__newest")
        return gr.join_records(df.filter(~is_open), group), {"held": clean(df.filter(is_open))}

    end = lambda st: gr.multiline(st["held"], start, timeout, per_service=per_service)
    return StreamStep(step, ["held"], end)


def reorder(window, extract) -> StreamStep:
    """Lines of the last arrival slot are held back, so that slots do not depend on batches."""
    us = duration_micros(window)

    def step(df, st):
        df = _with_held(df, st)
        first = df.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"))
        start = cut(st["start"] if "start" in st else first)
        df = cut(od.with_slots(df, us, extract, F.lit(start.first()[0])))
        last = df.agg(F.max("__slot")).first()[0]
        is_open = F.col("__slot") == F.lit(last)
        out, rows = od.sort_slots(df.filter(~is_open), st.get("rows"))
        return out, {"rows": rows, "start": start, "held": clean(df.filter(is_open))}

    def end(st):
        df = od.with_slots(st["held"], us, extract, F.lit(st["start"].first()[0]))
        return od.sort_slots(df, st.get("rows"))[0]

    return StreamStep(step, ["rows", "start", "held"], end)


def batches(size: int, interval=None) -> StreamStep:
    """The last batch is held back unless it is full; ``batch_id`` counts lines from the start."""

    def step(df, st):
        done = st["done"].first()[0] if "done" in st else 0
        df = cut(gr.with_batch(_with_held(df, st), size, interval))
        last, rows = df.agg(F.max("batch_start"), F.count(F.lit(1))).first()
        is_open = (F.col("batch_start") == F.lit(last)) & F.lit(rows - (last or 0) + 1 < size)
        held = df.filter(is_open).drop("batch_start")
        out = gr.collect_batches(df.filter(~is_open), F.col("batch_start") + done)
        left = rows - (rows - last + 1 if rows and rows - last + 1 < size else 0)
        total = df.sparkSession.createDataFrame([(done + left,)], "done bigint")
        return out, {"held": held, "done": total}

    def end(st):
        done = st["done"].first()[0]
        df = gr.with_batch(st["held"], size, interval)
        return gr.collect_batches(df, F.col("batch_start") + done)

    return StreamStep(step, ["held", "done"], end)


def drift(mode: str = "uniq", threshold: float = 0.8) -> StreamStep:
    """``seen`` grows by the forms that are new in a batch."""

    def step(df, st):
        seen = st.get("seen")
        new = dr.first_seen(df)
        if seen is not None:
            new = new.join(seen.select("norm"), "norm", "left_anti")
        new = cut(new)
        if mode == "fuzzy":
            return dr.mark_firsts(df, dr.unlike(new, threshold, seen)), {"seen": new}
        return dr.mark_firsts(df, new), {"seen": new}

    return StreamStep(step, ["seen"])
