"""Sinks: bucketed output and printed lines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loglane.operators.filters import route
from loglane.operators.transforms import render


def write_buckets(
    df: DataFrame,
    rules: list[tuple[str, str]],
    path: str,
    default: str = "",
    *,
    wanted: list[str] | None = None,
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> None:
    """Write each line under the folder of its bucket.

    Every task writes the buckets it meets, so a bucket that gets a third of all lines is written
    by all tasks and nothing is shuffled.
    """
    route(df, rules, default, wanted=wanted).write.mode(mode).partitionBy("bucket").format(fmt).save(path)


def stream_buckets(
    df: DataFrame,
    rules: list[tuple[str, str]],
    path: str,
    checkpoint: str,
    default: str = "",
    *,
    wanted: list[str] | None = None,
    fmt: str = "parquet",
):
    """The same for a stream."""
    out = route(df, rules, default, wanted=wanted).writeStream.partitionBy("bucket").format(fmt)
    return (
        out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def write_rendered(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the rendered lines as text files."""
    render(df).select("output").write.mode(mode).text(path)
