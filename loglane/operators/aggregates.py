"""Counts per service, window, text and rule. All are map-side combined, so hot keys are cheap."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglane.functions.regex import matches, translate
from loglane.plans.chunks import Carry, add_chunks, carry, clean, local
from loglane.schema import duration_micros, interval, micros, require


def _positive(name: str, value) -> int:
    us = duration_micros(value, name)
    if us <= 0:
        raise ValueError(f"{name} must be positive, got {value!r}")
    return us


def window_counts(df: DataFrame, window: timedelta | float | str) -> DataFrame:
    """Lines per service and tumbling window: ``key, count, window_end`` (A1).

    Works on streams too; give the stream a watermark first (``streaming.windows``).
    """
    require(df, "service", "ts")
    w = F.window("ts", interval(_positive("window", window)))
    counts = df.groupBy(w.alias("w"), "service").agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("service").alias("key"), "count", F.col("w.end").alias("window_end"))


def line_counts(df: DataFrame) -> DataFrame:
    """Lines per service, unnamed services left out: ``service, count`` (A2)."""
    require(df, "service")
    named = df.filter(F.col("service") != "")
    return named.groupBy("service").agg(F.count(F.lit(1)).alias("count"))


def line_count(df: DataFrame, service: str) -> DataFrame:
    """The count of one service, 0 if it never appeared (A2)."""
    return df.filter(F.col("service") == service).agg(F.count(F.lit(1)).alias("count"))


def text_counts(df: DataFrame) -> DataFrame:
    """How often each text occurs in each service."""
    require(df, "service", "text")
    return df.groupBy("service", F.col("text").alias("line")).agg(F.count(F.lit(1)).alias("count"))


def rank_texts(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest counts per service; ties by text."""
    order = [F.col("count").desc(), F.col("line").asc()]
    # First within slices of a service, then over the winners, so that a service with very many
    # distinct texts is not ranked by one task.
    slices = counts.withColumn("__slice", F.pmod(F.xxhash64("line"), F.lit(64)))
    part = Window.partitionBy("service", "__slice").orderBy(*order)
    best = slices.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= n)
    whole = Window.partitionBy("service").orderBy(*order)
    ranked = best.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= n)
    return ranked.drop("__slice", "__r")


def top_lines(df: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent texts of each service: ``service, line, count, rank`` (A3)."""
    if n < 1:
        raise ValueError(f"top_lines: n must be >= 1, got {n}")
    return rank_texts(text_counts(df), n)


def _check_rules(rules: list[tuple[str, str]]) -> None:
    if not rules:
        raise ValueError("alerts: at least one rule is required")
    for name, pattern in rules:
        if not name:
            raise ValueError("alerts: rule name must not be empty")
        translate(pattern)


def alerts(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """One row per line and matching ``(rule, pattern)``: ``rule, service, line, seq, ts`` (A4)."""
    require(df, "service", "text")
    _check_rules(rules)
    text = F.col("text")
    hits = F.array_compact(F.array(*[F.when(matches(text, p), F.lit(n)) for n, p in rules]))
    extra = [c for c in ("seq", "ts") if c in df.columns]
    return df.select(F.explode(hits).alias("rule"), "service", text.alias("line"), *extra)


def alert_counts(
    df: DataFrame, rules: list[tuple[str, str]], window: timedelta | float | str
) -> DataFrame:
    """Alerts per rule, service and tumbling window (A5)."""
    require(df, "ts")
    w = F.window("ts", interval(_positive("window", window)))
    counts = alerts(df, rules).groupBy(w.alias("w"), "rule", "service")
    return counts.agg(F.count(F.lit(1)).alias("count")).select(
        "rule", "service", "count", F.col("w.end").alias("window_end")
    )


def rolling_count(
    df: DataFrame, size: timedelta | float | str, *, chunks: int | None = None
) -> DataFrame:
    """Add ``count``: the service's lines in the last ``size`` up to each line's time.

    Both ends count. Lines of one service and time are counted once (map-side combined); each
    such moment asks how many lines lie before ``time - size`` by a marker row placed there, and
    one running sum over lines and markers answers all of them, whatever the density.
    """
    require(df, "service", "ts")
    us = _positive("size", size)
    df = df.withColumn("__us", micros(df))
    moments = df.groupBy("service", F.col("__us").alias("at")).agg(
        F.count(F.lit(1)).alias("__lines")
    )
    both = F.array(
        F.struct(F.col("at").alias("t"), F.lit(1).alias("kind"), F.col("__lines").alias("lines")),
        F.struct((F.col("at") - us).alias("t"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("lines")),
    )
    marks = moments.select("service", "at", F.inline(both))
    order = ["t", "kind"]
    marks, _ = carry(
        add_chunks(marks, order, chunks), "service", [Carry("__n", F.sum("lines"), "sum")]
    )
    w = local("service", order).rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("so_far", F.col("__n") + F.sum("lines").over(w))
    signed = F.when(F.col("kind") == 1, F.col("so_far")).otherwise(-F.col("so_far"))
    answer = marks.groupBy("service", "at").agg(F.sum(signed).alias("count"))
    answer = answer.select(
        F.coalesce("service", F.lit("")).alias("__s"),
        F.col("service").isNull().alias("__sn"),
        F.col("at").alias("__us"),
        "count",
    )
    # Unique on the right; a moment that many lines share is split by the adaptive skew join.
    df = df.withColumn("__s", F.coalesce("service", F.lit("")))
    df = df.withColumn("__sn", F.col("service").isNull())
    return clean(df.join(answer, ["__s", "__sn", "__us"], "left"))


def count_at(df: DataFrame, now: datetime, size: timedelta | float | str) -> DataFrame:
    """Lines per service with ``now - size <= ts <= now``."""
    require(df, "service", "ts")
    us = _positive("size", size)
    kind = df.schema["ts"].dataType
    end = F.lit(now).cast(kind)
    start = F.lit(now - timedelta(microseconds=us)).cast(kind)
    recent = df.filter((F.col("ts") >= start) & (F.col("ts") <= end))
    return recent.groupBy("service").agg(F.count(F.lit(1)).alias("count"))
