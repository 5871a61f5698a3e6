"""Text log files as log tables and streams."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loglane.plans.lineage import broadcast_if_small, cut
from loglane.sources.combine import merge


def _check(sources: Mapping[str, str]) -> list[tuple[str, str]]:
    """At least one source, every name and path non-empty (a mapping has unique names)."""
    if not sources:
        raise ValueError("at least one source is required")
    for name, path in sources.items():
        if not name or not name.strip():
            raise ValueError("source name must not be empty")
        if not path:
            raise ValueError(f"source {name!r} needs a path")
    return list(sources.items())


def _file_bases(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file: ``path`` and the number of bytes, and one more each, of the files before it.

    The binary file source lists files with their lengths; contents are not read.
    """
    parts = [
        spark.read.format("binaryFile").load(p).select("path", "length", F.lit(i).alias("source"))
        for i, p in enumerate(paths)
    ]
    w = Window.orderBy("source", "path").rowsBetween(Window.unboundedPreceding, -1)
    return merge(*parts).select(
        F.col("source").alias("__source"),
        F.col("path").alias("__path"),
        F.coalesce(F.sum(F.col("length") + 1).over(w), F.lit(0)).alias("__base"),
    )


def _same_path(path: Column) -> Column:
    # One scheme writes its local paths with one or with three slashes.
    return F.regexp_replace(path, "^file:/+", "file:/")


def read_logs(spark: SparkSession, sources: Mapping[str, str], *, ts: Column | None = None) -> DataFrame:
    """One row per line of the files of each ``{service: path}``.

    ``seq`` follows the sources in the order given, their files by name, and the lines in each file, without a shuffle
    of lines: a file split begins with the number of bytes before it, and a line adds its place in the split, which
    has no more lines than bytes. So numbers are unique for splits of any size. The text is read twice, the
    first time for the splits' first lines alone. ``ts`` defaults to the file's modification time. A missing path
    is an error.
    """
    entries = _check(sources)
    paths = [p for _, p in entries]
    bases = _file_bases(spark, paths).withColumn("__path", _same_path(F.col("__path")))
    parts = []
    for i, (service, path) in enumerate(entries):
        lines = spark.read.text(path, lineSep="\n").select(
            F.lit(i).alias("__source"),
            F.lit(service).alias("service"),
            F.col("value").alias("text"),
            _same_path(F.col("_metadata.file_path")).alias("__path"),
            F.col("_metadata.file_block_start").alias("__start"),
            F.col("_metadata.file_modification_time").alias("__modified"),
            F.monotonically_increasing_id().alias("__id"),
        )
        parts.append(lines)
    df = merge(*parts)
    # A task may read several splits, each from its first line to its last.
    split = ["__source", "__path", "__start"]
    splits = df.groupBy(*split).agg(F.min("__id").alias("__first")).join(bases, ["__source", "__path"])
    # One small row per split.
    df = df.join(broadcast_if_small(cut(splits)), split)
    # The line at byte 0 belongs to the first split; others begin with the first line after their first byte.
    later = F.when(F.col("__start") > 0, 1).otherwise(0)
    seq = F.col("__base") + F.col("__start") + later + F.col("__id") - F.col("__first")
    at = F.col("__modified") if ts is None else ts
    return df.select(seq.alias("seq"), "service", "text", at.alias("ts"))


def stream_logs(
    spark: SparkSession,
    sources: Mapping[str, str],
    *,
    start: datetime | None = None,
    max_files_per_trigger: int | None = None,
    ts: Column | None = None,
) -> DataFrame:
    """The same as a stream: each new file in a source's folder arrives once.

    Columns ``service, text, ts`` and ``place`` (the file and split of the line);
    ``streaming.stateful`` numbers the lines. ``start`` skips files last written before it; give
    the same value when the query is started again.
    """
    parts = []
    for service, path in _check(sources):
        reader = spark.readStream.format("text").option("lineSep", "\n")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        lines = reader.load(path)
        if start is not None:
            lines = lines.filter(F.col("_metadata.file_modification_time") >= F.lit(start))
        place = F.struct(
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
        )
        parts.append(
            lines.select(
                F.lit(service).alias("service"),
                F.col("value").alias("text"),
                (F.col("_metadata.file_modification_time") if ts is None else ts).alias("ts"),
                place.alias("place"),
            )
        )
    return merge(*parts)
