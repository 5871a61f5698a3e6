"""Cutting lineage in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables are broadcast up to this many bytes, counted as the bytes of texts and 16 for every other value.
BROADCAST_BYTES = 64 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; make one only where none is set, as in local tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="loglane-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once, reliably, and read it from there in every later use."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Ask for a broadcast only where the table, measured, is small; else leave the join to Spark.

    ``df`` should be narrow and cheap to read again (a table, or the result of ``cut``). Its size is summed up in
    every partition first, so that no task sees all rows.
    """
    texts = [F.coalesce(F.octet_length(f"`{n}`"), F.lit(0)) for n, kind in df.dtypes if kind == "string"]
    width = sum(texts, F.lit(16 * (len(df.columns) - len(texts)) + 16)).cast("bigint")
    size = df.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df
