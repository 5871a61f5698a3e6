"""The canonical log table and the small helpers every operator shares."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("service", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
        T.StructField("ts", T.TimestampType(), True),
    ]
)

LOG_COLUMNS = ("seq", "service", "text", "ts")


def as_logs(
    df: DataFrame,
    *,
    seq: Column | str = "seq",
    service: Column | str = "service",
    text: Column | str = "text",
    ts: Column | str = "ts",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Map any table to the canonical log columns (S3).

    ``seq`` must be unique and rise with arrival order. Timestamps keep their type, with or
    without time zone. ``keep`` names further columns to carry along.
    """

    def col(c: Column | str) -> Column:
        return F.col(c) if isinstance(c, str) else c

    return df.select(
        col(seq).cast("bigint").alias("seq"),
        col(service).cast("string").alias("service"),
        col(text).cast("string").alias("text"),
        col(ts).alias("ts"),
        *keep,
    )


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; map the table with as_logs first")


def micros(df: DataFrame, name: str = "ts") -> Column:
    """Microseconds since the epoch of a timestamp column, with or without time zone.

    Timestamps without zone are read in the session time zone, which should be UTC.
    """
    return F.unix_micros(F.col(name).cast("timestamp"))


def from_micros(df: DataFrame, value: Column, like: str = "ts") -> Column:
    """Turn microseconds back into the type the column ``like`` has."""
    return F.timestamp_micros(value).cast(df.schema[like].dataType)


def duration_micros(value: timedelta | int | float | str, name: str = "duration") -> int:
    """Accept a timedelta, seconds, or text such as ``'90 seconds'`` or ``'1h30m'``, and return microseconds."""
    if isinstance(value, str):
        short = re.fullmatch(r"(?:\d+(?:\.\d+)?(?:h|ms|m|s|us))+", value)
        if short:
            sizes = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000}
            return round(sum(float(n) * sizes[u] for n, u in re.findall(r"([\d.]+)([a-z]+)", value)))
        units = {
            "microsecond": 1,
            "millisecond": 1_000,
            "second": 1_000_000,
            "minute": 60_000_000,
            "hour": 3_600_000_000,
            "day": 86_400_000_000,
        }
        parts = value.split()
        unit = parts[1].rstrip("s").lower() if len(parts) == 2 else ""
        if unit not in units:
            raise ValueError(f"{name}: cannot read {value!r}, expected e.g. '10 seconds'")
        return round(float(parts[0]) * units[unit])
    if isinstance(value, timedelta):
        return value // timedelta(microseconds=1)
    return round(float(value) * 1_000_000)


def interval(us: int) -> str:
    """Interval text for ``window``/``session_window``/``withWatermark``."""
    return f"{us} microseconds"
