"""Snapshots: captured lines to compare a later run with. Checkpoints: how far each service was read."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglane.operators.ordered import with_byte_offset
from loglane.plans.lineage import broadcast_if_small
from loglane.schema import require

JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
SNAPSHOT_SCHEMA = "service string, line string, captured_at timestamp, created_at timestamp"
CHECKPOINT_SCHEMA = "service string, offset bigint, updated_at timestamp"


def collect_snapshot(df: DataFrame, created_at: datetime | None = None) -> DataFrame:
    """Log lines as snapshot entries ``service, line, captured_at, created_at``."""
    require(df, "service", "text")
    at = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    captured = F.col("ts").cast("timestamp") if "ts" in df.columns else at
    return df.select(
        "service", F.col("text").alias("line"), captured.alias("captured_at"), at.alias("created_at")
    )


def _writer(df: DataFrame, fmt: str, mode: str):
    if fmt not in ("json", "parquet"):
        raise ValueError(f"snapshot format must be json or parquet, got {fmt!r}")
    writer = df.write.mode(mode)
    return _entries(writer, fmt)


def _entries(writer, fmt: str):
    # Null fields and microseconds are kept, so that the entries read back as they were.
    if fmt == "json":
        writer = writer.option("ignoreNullFields", "false").option("timestampFormat", JSON_TIME)
    return writer.format(fmt)


def save_snapshot(
    df: DataFrame, path: str, fmt: str = "json", *, created_at: datetime | None = None, mode: str = "overwrite"
) -> None:
    """Write a snapshot of all lines as a folder of JSON lines or Parquet."""
    _writer(collect_snapshot(df, created_at), fmt, mode).save(path)


def stream_snapshot(df: DataFrame, path: str, checkpoint: str, fmt: str = "json"):
    """Write the lines of a stream as snapshot entries."""
    out = _entries(collect_snapshot(df).writeStream, fmt).option("path", path)
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_snapshot(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Read a snapshot; a missing folder or a corrupt entry is an error."""
    reader = spark.read.schema(SNAPSHOT_SCHEMA)
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    return reader.format(fmt).load(path)


def snapshot_logs(snapshot: DataFrame) -> DataFrame:
    """Snapshot entries under the names that drift operators expect."""
    return snapshot.select("service", F.col("line").alias("text"), F.col("captured_at").alias("ts"))


# --- offsets -----------------------------------------------------------------------------------


def empty_checkpoint(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHECKPOINT_SCHEMA)


def set_offsets(checkpoint: DataFrame, updates: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Checkpoint with the updates ``service, offset[, updated_at]`` in place.

    An empty service or a negative offset fails the job.
    """
    at = F.current_timestamp() if updated_at is None else updated_at
    if "updated_at" in updates.columns:
        at = F.col("updated_at")
    bad = F.when(F.coalesce("service", F.lit("")) == "", F.raise_error("checkpoint: service name must not be empty"))
    bad = bad.when(F.col("offset") < 0, F.raise_error("checkpoint: offset must be non-negative"))
    new = updates.select(
        F.coalesce(bad.cast("string"), F.col("service")).alias("service"),
        F.col("offset").cast("bigint").alias("offset"),
        at.alias("updated_at"),
        F.lit(1).alias("round"),
    )
    both = checkpoint.withColumn("round", F.lit(0)).unionByName(new)
    # An update replaces what was stored, whatever the clocks say.
    latest = F.max_by(F.struct("offset", "updated_at"), F.struct("round", "updated_at", "offset"))
    return both.groupBy("service").agg(latest.alias("e")).select("service", "e.offset", "e.updated_at")


def get_offset(checkpoint: DataFrame, service: str) -> int:
    """The stored offset of a service, 0 if there is none."""
    row = checkpoint.filter(F.col("service") == service).agg(F.max("offset")).first()
    return row[0] or 0


def _complete(spark: SparkSession, path: str) -> DataFrame:
    """``version, entries`` of the versions whose writing came to its end."""
    try:
        return spark.read.schema("version int, entries bigint").json(f"{path}/complete")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "version int, entries bigint")


def save_checkpoint(checkpoint: DataFrame, path: str, version: int) -> None:
    """Write version ``version`` under ``path``; a version is complete or does not count.

    The entries are written first, then a note of their number, which makes the version count. A complete version is
    never written again; what an interrupted writer left is replaced.
    """
    spark = checkpoint.sparkSession
    done = _complete(spark, path)
    if not done.filter(F.col("version") == version).isEmpty():
        raise ValueError(f"checkpoint: version {version} is already there")
    folder = f"{path}/version={version}"
    checkpoint.write.mode("overwrite").json(folder)
    entries = spark.read.schema(CHECKPOINT_SCHEMA).json(folder).count()
    note = spark.range(1).coalesce(1).select(F.lit(version).alias("version"), F.lit(entries).alias("entries"))
    note.write.mode("append").json(f"{path}/complete")


def load_checkpoint(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Read a version, by default the newest complete one; empty if nothing was saved.

    Folders without a note, as an interrupted writer leaves them, are passed over. A version that is asked for and is
    not complete, or has lost entries since, is an error.
    """
    done = _complete(spark, path)
    newest = done.agg(F.max("version")).first()[0]
    if version is None:
        if newest is None:
            return empty_checkpoint(spark)
        version = newest
    elif done.filter(F.col("version") == version).isEmpty():
        raise ValueError(f"checkpoint: version {version} is not complete")
    table = spark.read.schema(CHECKPOINT_SCHEMA).option("mode", "FAILFAST").json(f"{path}/version={version}")
    noted, held = done.filter(F.col("version") == version).agg(F.max("entries")).first()[0], table.count()
    if noted != held:
        raise ValueError(f"checkpoint: version {version} has {held} of {noted} entries")
    return table.filter(F.coalesce("service", F.lit("")) != "")


def resume(df: DataFrame, checkpoint: DataFrame, *, chunks: int | None = None) -> DataFrame:
    """Lines at or past the stored byte offset of their service."""
    stored = checkpoint.select(F.col("service").alias("__svc"), F.col("offset").alias("__stored"))
    # One small row per service.
    stored = broadcast_if_small(stored)
    lines = with_byte_offset(df, chunks=chunks).join(stored, F.col("service") == F.col("__svc"), "left")
    kept = lines.filter(F.col("offset") >= F.coalesce("__stored", F.lit(0)))
    return kept.drop("__svc", "__stored", "offset")
