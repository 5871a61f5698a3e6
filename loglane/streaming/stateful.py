"""Order-dependent operators on streams.

Each micro-batch runs the same distributed operator as a whole table, with the summary of all earlier
batches as its starting state. Keyed streaming state would put a busy service into one task of each
batch; this does not. State and output of a batch are written under the batch's number, and a batch
that is run again after a failure overwrites both, so every line counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loglane.plans.chunks import clean, with_position
from loglane.plans.lineage import cut

State = dict[str, DataFrame]
Step = Callable[[DataFrame, State], tuple[DataFrame, State]]

# Names of state tables that grow by what is new in a batch instead of being replaced.
GROWS = "seen"
# The table that says which batches are done.
DONE = "ended"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def load_state(spark: SparkSession, folder: str, names: list[str], batch: int) -> State:
    """State after ``batch``."""
    found = {}
    for name in names:
        if name == GROWS:
            df = _read(spark, f"{folder}/{name}")
            df = None if df is None else df.filter(F.col("batch") <= batch).drop("batch")
        else:
            df = _read(spark, f"{folder}/{name}/batch={batch}") if batch >= 0 else None
        if df is not None:
            found[name] = df
    return found


def number_lines(df: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Replace ``place`` (where a line came from) by ``seq``, counting over all batches."""
    split = ["modified", "path", "start"]
    # Lines of a split stand in one task in their order.
    df = cut(df.select("*", "place.*", F.monotonically_increasing_id().alias("__id")).drop("place"))
    # One row per file split of the batch.
    splits = df.select(*split).distinct()
    splits = splits.withColumn("__split", F.row_number().over(Window.orderBy(*split)))
    df = df.join(splits, split).drop(*split)
    df, after = with_position(df, ["__split", "__id"], None, state, name="seq")
    return clean(df), after


def run(
    stream: DataFrame,
    step: Step,
    *,
    output: str,
    state: str,
    checkpoint: str,
    names: list[str],
    fmt: str = "parquet",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start ``step`` on a stream; results go to ``output/batch=<n>``.

    ``names`` are the state tables of the step (see ``steps``). By default all data that is there
    is processed, in as many batches as the source makes, and the query ends.
    """

    def on_batch(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        before = load_state(spark, state, [*names, "lines"], batch - 1)
        after: State = {}
        if "place" in df.columns:
            df, after["lines"] = number_lines(df, before.get("lines"))
        out, new = step(df, before)
        after.update(new)
        out.write.mode("overwrite").format(fmt).save(f"{output}/batch={batch}")
        for name, table in after.items():
            table.write.mode("overwrite").parquet(f"{state}/{name}/batch={batch}")
        # A row of its own says that the batch is done, whether or not anything is held.
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{state}/{DONE}/batch={batch}")

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def finish(spark: SparkSession, end: Callable[[State], DataFrame], *, state: str, names: list[str]) -> DataFrame:
    """What a step still holds when its stream is over (the last open run, record or batch)."""
    done = _read(spark, f"{state}/{DONE}")
    newest = -1 if done is None else done.agg(F.max("batch")).first()[0]
    return end(load_state(spark, state, names, newest))
