"""Stateless filters."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglane.functions.layouts import DEFAULT_LAYOUTS, leading_time
from loglane.functions.regex import matches_any, translate
from loglane.schema import duration_micros, require

# Level names in rising order.
LEVELS = ("debug", "info", "warn", "error")


def include_exclude(
    df: DataFrame, include: list[str] = (), exclude: list[str] = ()
) -> DataFrame:
    """Keep lines that match an include pattern (all if there is none) and no exclude pattern (F1)."""
    require(df, "text")
    text, keep = F.col("text"), F.lit(True)
    if include:
        keep = matches_any(text, list(include))
    if exclude:
        keep = keep & ~matches_any(text, list(exclude))
    return df.filter(keep)


def grep(df: DataFrame, patterns: list[str], *, invert: bool = False) -> DataFrame:
    """Keep lines that match any pattern, or none of them with ``invert`` (F2)."""
    require(df, "text")
    if not patterns:
        raise ValueError("grep: at least one pattern is required")
    hit = matches_any(F.col("text"), list(patterns))
    return df.filter(~hit if invert else hit)


def level(text: Column) -> Column:
    """0 debug, 1 info, 2 warn, 3 error, by the first of ERROR, WARN, INFO in the text."""
    upper = F.upper(text)
    return (
        F.when(upper.contains("ERROR"), 3)
        .when(upper.contains("WARN"), 2)
        .when(upper.contains("INFO"), 1)
        .otherwise(0)
    )


def level_filter(df: DataFrame, minimum: str) -> DataFrame:
    """Keep lines of at least the given level."""
    require(df, "text")
    name = str(minimum).lower()
    if name not in LEVELS:
        raise ValueError(f"unknown level {minimum!r}, expected one of {LEVELS}")
    return df.filter(level(F.col("text")) >= LEVELS.index(name))


def cutoff_time(cutoff: datetime | timedelta | str, now: datetime | None = None) -> datetime:
    """A time, or the time a duration such as ``10m`` before ``now`` (by default the clock's, once); without zone UTC."""
    if isinstance(cutoff, (timedelta, str)):
        span = duration_micros(cutoff, "since")
        if span <= 0:
            raise ValueError(f"since: a duration must be positive, got {cutoff!r}")
        cutoff = (now or datetime.now(timezone.utc)) - timedelta(microseconds=span)
    if not isinstance(cutoff, datetime):
        raise ValueError("since: a cutoff time is required")
    return cutoff.replace(tzinfo=timezone.utc) if cutoff.tzinfo is None else cutoff


def since(
    df: DataFrame, cutoff: datetime | timedelta | str, layouts: tuple[str, ...] = DEFAULT_LAYOUTS, *, now: datetime | None = None
) -> DataFrame:
    """Keep lines whose leading timestamp is not before ``cutoff``, or that have none.

    A duration (``10m``, ``1h30m``, a timedelta) counts back from ``now``, by default the time of the call.
    """
    require(df, "text")
    cutoff = cutoff_time(cutoff, now)
    at = leading_time(F.col("text"), tuple(layouts) or DEFAULT_LAYOUTS, cutoff.year)
    return df.filter(at.isNull() | (at >= F.lit(cutoff)))


def where(df: DataFrame, predicate: Column | Callable[[DataFrame], Column]) -> DataFrame:
    """Keep lines for which an arbitrary condition holds."""
    return df.filter(predicate(df) if callable(predicate) else predicate)


def route(
    df: DataFrame,
    rules: list[tuple[str, str]],
    default: str = "",
    *,
    wanted: list[str] | None = None,
) -> DataFrame:
    """Add ``bucket``: that of the first rule ``(bucket, pattern)`` that matches, else ``default``.

    Lines without a bucket, or with one not in ``wanted``, are dropped.
    """
    require(df, "text")
    if not rules:
        raise ValueError("route: at least one rule is required")
    bucket = None
    for name, pattern in rules:
        if not name:
            raise ValueError("route: bucket name must not be empty")
        hit = F.col("text").rlike(translate(pattern).java)
        bucket = F.when(hit, name) if bucket is None else bucket.when(hit, name)
    out = df.withColumn("bucket", bucket.otherwise(F.lit(default)))
    keep = F.col("bucket") != ""
    if wanted is not None:
        keep = keep & F.col("bucket").isin(list(wanted))
    return out.filter(keep)
