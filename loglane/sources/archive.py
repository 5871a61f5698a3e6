"""Lines kept with their byte offsets, and an index of what each file holds: a resumed run opens only files it needs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglane.operators.ordered import with_byte_offset
from loglane.plans.lineage import broadcast_if_small
from loglane.schema import require

ZONES = "service string, first bigint, end bigint, file string, round int"


def zones(spark: SparkSession, path: str) -> DataFrame:
    """The index: for each file and service the offset of the first line and the offset after the last.

    A row for each service in a file, so a few times as many rows as files.
    """
    try:
        return spark.read.schema(ZONES).parquet(f"{path}/zones")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ZONES)


def append_lines(df: DataFrame, path: str, round_number: int) -> None:
    """Add the lines of a round (0, 1, ...) to the archive at ``path``; offsets go on where earlier rounds end.

    Lines are written in ranges of service and offset, so a busy service has many files and a file few services. The
    index of a round is written last and makes it count: a round that was interrupted is written again.
    """
    require(df, "seq", "service", "text")
    spark, lines = df.sparkSession, f"{path}/lines/round={round_number}"
    if round_number < 0:
        raise ValueError(f"archive: round must be >= 0, got {round_number}")
    before = zones(spark, path).filter(F.col("round") < round_number).groupBy("service").agg(F.max("end").alias("__start"))
    # One small row per service.
    before = broadcast_if_small(before.withColumnRenamed("service", "__svc"))
    rows = with_byte_offset(df).join(before, F.col("service").eqNullSafe(F.col("__svc")), "left")
    rows = rows.withColumn("offset", F.col("offset") + F.coalesce("__start", F.lit(0))).drop("__svc", "__start")
    rows.repartitionByRange("service", "offset").sortWithinPartitions("service", "offset").write.mode("overwrite").parquet(lines)
    # Two narrow columns and the texts' lengths.
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    held = spark.read.schema(rows.schema).parquet(lines).groupBy("service", F.col("_metadata.file_name").alias("file"))
    held = held.agg(F.min("offset").alias("first"), F.max(F.col("offset") + size).cast("bigint").alias("end"))
    held.select("service", "first", "end", "file").coalesce(1).write.mode("overwrite").parquet(f"{path}/zones/round={round_number}")


def resume_lines(spark: SparkSession, path: str, checkpoint: DataFrame) -> DataFrame:
    """Lines of the archive at or past the stored byte offset of their service, with ``offset``.

    The index is compared with the checkpoint first, and only files with a line that is wanted are opened; services
    without a stored offset are read from their beginning. An empty archive is an error, an archive read to its end
    gives no rows.
    """
    index = zones(spark, path)
    stored = broadcast_if_small(checkpoint.select(F.col("service").alias("__svc"), F.col("offset").alias("__stored")))
    wanted = index.join(stored, F.col("service") == F.col("__svc"), "left").filter(F.col("end") > F.coalesce("__stored", F.lit(0)))
    # Names of files, as the reader itself would list them.
    names = sorted(f"{path}/lines/round={r['round']}/{r['file']}" for r in wanted.select("round", "file").distinct().collect())
    newest = index.agg(F.max("round")).first()[0]
    if newest is None:
        raise ValueError(f"archive: nothing at {path}")
    schema = spark.read.parquet(f"{path}/lines/round={newest}").schema
    if not names:
        return spark.createDataFrame([], schema)
    lines = spark.read.schema(schema).parquet(*names).join(stored, F.col("service") == F.col("__svc"), "left")
    return lines.filter(F.col("offset") >= F.coalesce("__stored", F.lit(0))).drop("__svc", "__stored")
