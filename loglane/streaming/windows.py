"""Aggregating operators on streams: watermark, windows and running totals.

Stateless operators (filters, transforms, alerts, merge, label, routing) take a streaming DataFrame
as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loglane.operators import aggregates as ag
from loglane.schema import duration_micros, interval, require


# The service of the line that ends a stream. Results under this name are to be left out where they are read: Spark
# would move a filter below the watermark, which the line is there to push on.
END = "\x03"


def with_end(df: DataFrame, after) -> DataFrame:
    """Lines with an end mark: one more line, ``after`` the last one, that closes all windows and sessions.

    ``after`` must be longer than a window and the watermark's delay together. A live stream gets such a line from
    whoever ends it.
    """
    require(df, "seq", "service", "text", "ts")
    last = df.agg((F.max("seq") + 1).alias("seq"), (F.max("ts") + F.expr(f"INTERVAL '{duration_micros(after) / 1e6:.6f}' SECOND")).alias("ts"))
    mark = last.filter("seq is not null").select("seq", F.lit(END).alias("service"), F.lit("").alias("text"), F.col("ts").cast(df.schema["ts"].dataType).alias("ts"))
    return df.select("seq", "service", "text", "ts").unionByName(mark)


def with_watermark(stream: DataFrame, delay) -> DataFrame:
    """Event time with a watermark. Spark needs a time with zone for it, so ``ts`` becomes one."""
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", interval(duration_micros(delay)))


def window_counts(stream: DataFrame, window, delay) -> DataFrame:
    """Counts per service and tumbling window, each final when the watermark passes (A1)."""
    return ag.window_counts(with_watermark(stream, delay), window)


def alert_counts(stream: DataFrame, rules, window, delay) -> DataFrame:
    """Alerts per rule, service and window (A5)."""
    return ag.alert_counts(with_watermark(stream, delay), rules, window)


def rolling_counts(stream: DataFrame, size, slide, delay) -> DataFrame:
    """Counts over the last ``size``, every ``slide``: ``service, count, window_end``."""
    require(stream, "service", "ts")
    w = F.window("ts", interval(duration_micros(size)), interval(duration_micros(slide)))
    counts = with_watermark(stream, delay).groupBy(w.alias("w"), "service").agg(F.count(F.lit(1)).alias("count"))
    return counts.select("service", "count", F.col("w.end").alias("window_end"))


def coalesce_bursts(stream: DataFrame, window, delay, *, sep: str = " | ") -> DataFrame:
    """Bursts of a service that ended more than ``window`` before the watermark."""
    require(stream, "seq", "service", "text", "ts")
    # A session merges events up to exactly its gap apart, which is the rule of the operator.
    session = F.session_window("ts", interval(duration_micros(window)))
    lines = F.array_sort(F.collect_list(F.struct("ts", "seq", F.coalesce("text", F.lit("")).alias("text"))))
    bursts = with_watermark(stream, delay).groupBy(session.alias("w"), "service").agg(lines.alias("lines"))
    return bursts.select(
        F.col("lines")[0]["seq"].alias("seq"),
        "service",
        F.array_join(F.transform("lines", lambda x: x["text"]), sep).alias("text"),
        F.col("lines")[0]["ts"].alias("ts"),
    )


def line_counts(stream: DataFrame) -> DataFrame:
    """Running totals per service; use output mode ``update`` or ``complete`` (A2)."""
    return ag.line_counts(stream)


def top_lines(stream: DataFrame, n: int, *, output: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Running totals per text, ranked after each batch into ``output/batch=<n>`` (A3)."""

    def rank(counts: DataFrame, batch: int) -> None:
        ag.rank_texts(counts, n).write.mode("overwrite").parquet(f"{output}/batch={batch}")

    writer = ag.text_counts(stream).writeStream.outputMode("complete").foreachBatch(rank)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
