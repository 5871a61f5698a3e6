"""Order-dependent work without one task holding one service, or all rows.

A window over a whole service, or over the whole stream, puts that service or stream into one
task. Here the order is cut into chunks of bounded size instead:

1. ``add_chunks`` gives every row a chunk number that rises with the order key. The cut points come
   from a sample of the key, as in a range partitioning; a key value that fills more than one chunk
   is cut further by the next column of the key, so ties do not pile up.
2. ``carry`` sums up each (group, chunk) with one map-side combined ``groupBy``, runs a window over
   those few summary rows, and joins what came before back to the rows of each chunk.
3. The caller uses ordinary windows over ``local(group)``: (group, chunk), in order. The join and
   these windows hash on the same columns, so the rows are shuffled once; windows that come before
   the join also leave the rows in its order, and what is joined to them is in no sort.

Streams call the same functions batch by batch: the summary of all earlier batches enters as a
chunk before the first one (``state``), and ``carry`` returns the summary after the last.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "__chunk"
ARRIVAL_CHUNK = "__arrival_chunk"

# Rows per chunk once there are many, the least worth a chunk of its own, and the most chunks.
ROWS_PER_CHUNK = 100_000
MIN_ROWS_PER_CHUNK = 1_000
MAX_CHUNKS = 16_384
SAMPLES_PER_CHUNK = 40

_GROUP = ("__group", "__group_null")


@dataclass(frozen=True)
class Carry:
    """One carried value: how a chunk is summed up and how summaries combine in order.

    ``how`` is ``sum``, ``max``, ``last`` or ``first`` (the last two skip nulls).
    """

    name: str
    agg: Column
    how: str

    def before(self, w: WindowSpec) -> Column:
        c = F.col(self.name)
        if self.how == "sum":
            return F.coalesce(F.sum(c).over(w), F.lit(0))
        if self.how == "max":
            return F.max(c).over(w)
        if self.how == "first":
            return F.first(c, ignorenulls=True).over(w)
        return F.last(c, ignorenulls=True).over(w)

    def total(self) -> Column:
        c = F.col(self.name)
        if self.how == "sum":
            return F.sum(c)
        if self.how == "max":
            return F.max(c)
        # The extremum skips null orderings, so chunks without a value do not count.
        order = F.when(c.isNotNull(), F.col(CHUNK))
        return F.min_by(c, order) if self.how == "first" else F.max_by(c, order)


def count_rows(name: str = "__n") -> Carry:
    return Carry(name, F.count(F.lit(1)), "sum")


def last_row(value: Column, order: list[str], name: str) -> Carry:
    """The value in the last row of the chunk, wrapped so that a null value still counts."""
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return Carry(name, F.max_by(F.struct(value.alias("v")), by), "last")


def number_of_chunks(df: DataFrame, rows: int) -> int:
    """Enough chunks to use every core and to bound the size of each; one for small inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    # From 1000 chunks on they grow first, up to ten times: their summaries meet in one window.
    wanted = max(cores, min(-(-rows // ROWS_PER_CHUNK), max(1000, -(-rows // (10 * ROWS_PER_CHUNK)))))
    return max(1, min(wanted, rows // MIN_ROWS_PER_CHUNK, MAX_CHUNKS))


def _as_double(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    # Casting to double never reverses an order. Nulls sort first.
    return F.coalesce(c.cast("double"), F.lit(-1.0e300))


def add_chunks(df: DataFrame, order: list[str], chunks: int | None = None) -> DataFrame:
    """Add ``__chunk``: a number that never falls as ``order`` rises.

    Counts the rows and samples the order columns (both read these columns only), unless
    ``chunks`` is 1. The result of ``df`` must be repeatable, as for any multi-pass job.
    """
    if CHUNK in df.columns:
        return df
    if order == ["seq"] and ARRIVAL_CHUNK in df.columns:
        return df.withColumn(CHUNK, F.col(ARRIVAL_CHUNK))
    if chunks is None or chunks > 1:
        keys = df.select(*[_as_double(df, c).alias(f"k{i}") for i, c in enumerate(order)])
        rows = keys.count()
        if chunks is None:
            chunks = number_of_chunks(df, rows)
    if chunks <= 1 or rows == 0:
        return df.withColumn(CHUNK, F.lit(0).cast("bigint"))
    fraction = min(1.0, max(SAMPLES_PER_CHUNK * chunks, 2_000) / rows)
    picked = keys.toPandas() if fraction == 1.0 else keys.sample(fraction, seed=17).toPandas()
    sample = picked.to_numpy(dtype=float)

    out = df
    chunk = F.lit(0).cast("bigint")
    step = max(1, len(sample) // chunks)
    live = np.ones(len(sample), dtype=bool)
    tie = np.zeros(len(sample))
    in_tie, tie_col = F.lit(True), F.lit(0.0)
    temp: list[str] = []
    for level, name in enumerate(order):
        key, key_col = sample[:, level], _as_double(df, name)
        if level:
            # Order inside each tied value: the number of the tie plus a fraction below one half.
            low, high = (key[live].min(), key[live].max()) if live.any() else (0.0, 1.0)
            span = max(high - low, 1.0)
            key = tie + np.clip((key - low) / span, 0.0, 1.0) / 2
            part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (key_col - F.lit(low)) / F.lit(span)))
            key_col = tie_col + part / F.lit(2.0)
        cuts = np.sort(key[live])[step::step]
        values, times = np.unique(cuts, return_counts=True)
        hot = values[times > 1]
        bounds = np.unique(np.concatenate([values, np.nextafter(hot, np.inf)]))
        k, b = f"__k{level}", f"__b{level}"
        temp += [k, b]
        splits = [-np.inf, *bounds.tolist(), np.inf]
        out = Bucketizer(splits=splits, inputCol=k, outputCol=b).transform(
            out.withColumn(k, key_col)
        )
        # Never null; saying so saves the join a filter that would compute it twice.
        bucket = F.coalesce(F.col(b).cast("bigint"), F.lit(0))
        chunk = chunk * F.lit(len(bounds) + 1) + F.when(in_tie, bucket).otherwise(F.lit(0))
        if not len(hot) or level + 1 == len(order):
            break
        # Only rows with one of the hot values need the next column.
        place = np.searchsorted(bounds, key, side="right")
        numbers = {int(np.searchsorted(bounds, v, side="right")): i for i, v in enumerate(hot)}
        live = live & np.isin(place, list(numbers))
        tie = np.array([numbers.get(int(p), 0) for p in place], dtype=float)
        lookup = F.create_map(*[F.lit(x) for kv in numbers.items() for x in (kv[0], float(kv[1]))])
        number = lookup[bucket.cast("int")]
        in_tie = in_tie & number.isNotNull()
        tie_col = F.coalesce(number, F.lit(0.0))
    return out.withColumn(CHUNK, chunk).drop(*temp)


def with_arrival_chunks(df: DataFrame, chunks: int | None = None) -> DataFrame:
    """Cut a table by ``seq`` once for a chain of operators.

    The chunk column stays on the rows, so each operator of the chain takes it over instead of
    counting and sampling its input.
    """
    return add_chunks(df, ["seq"], chunks).withColumnRenamed(CHUNK, ARRIVAL_CHUNK)


def with_group(df: DataFrame, group: str | None) -> DataFrame:
    """Two non-null columns that stand for the group, so that joins on it are plain equality."""
    if group is None or _GROUP[0] in df.columns:
        return df
    return df.withColumn(_GROUP[0], F.coalesce(F.col(group), F.lit(""))).withColumn(
        _GROUP[1], F.col(group).isNull()
    )


def keys_of(group: str | None) -> list[str]:
    return list(_GROUP) if group else []


def carry(
    df: DataFrame,
    group: str | None,
    carries: list[Carry],
    state: DataFrame | None = None,
    reverse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Join to every row what the earlier chunks of its group carry; also return the new state."""
    df = with_group(df, group)
    keys = keys_of(group)
    summary = df.groupBy(*keys, CHUNK).agg(*[c.agg.alias(c.name) for c in carries])
    if state is not None:
        summary = state.withColumn(CHUNK, F.lit(-1).cast("bigint")).unionByName(summary)
    order = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = summary.select(*keys, CHUNK, *[c.before(w).alias(c.name) for c in carries])
    after = summary.groupBy(*keys).agg(*[c.total().alias(c.name) for c in carries])
    return with_summary(df, before, [*keys, CHUNK]), after


def with_summary(df: DataFrame, before: DataFrame, on: list[str]) -> DataFrame:
    """Join rows of chunks with one row per chunk, in the tasks that hold the chunks.

    Without the hint Spark may take either side for the small one, and send the rows through the driver.
    """
    return df.join(before.hint("merge"), on)


def local(group: str | None, order: list[str], reverse: bool = False) -> WindowSpec:
    by = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    return Window.partitionBy(*keys_of(group), CHUNK).orderBy(*by)


def clean(df: DataFrame, *keep: str) -> DataFrame:
    """Drop the helper columns of this module and of its callers."""
    keep = (*keep, ARRIVAL_CHUNK)
    return df.drop(*[c for c in df.columns if c.startswith("__") and c not in keep])


def with_position(
    df: DataFrame,
    order: list[str],
    group: str | None = None,
    state: DataFrame | None = None,
    chunks: int | None = None,
    name: str = "__pos",
) -> tuple[DataFrame, DataFrame]:
    """Add the 1-based position of each row in its group, or in the whole input."""
    df = with_group(add_chunks(df, order, chunks), group)
    df, after = carry(df.withColumn("__rn", F.row_number().over(local(group, order))), group, [count_rows()], state)
    return df.withColumn(name, (F.col("__n") + F.col("__rn")).cast("bigint")).drop("__n", "__rn"), after


def with_runs(
    df: DataFrame,
    order: list[str],
    group: str | None,
    value: str,
    starts,
    state: DataFrame | None = None,
    chunks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Add ``__pos`` and ``__start``: a row's position and that of the first row of its run.

    ``starts(previous, value)`` says whether a row opens a run, given its column ``value`` and that of
    the row before it in its group; the first row of a group always opens one.

    Only the first row of a chunk needs to know what came before, so the chunks are summed up from
    windows inside them, over the few columns involved, and the first rows are settled in the
    summary. All columns are shuffled once, and the value is in them once.
    """
    df = with_group(add_chunks(df, order, chunks), group)
    keys, w = keys_of(group), local(group, order)

    def inside(rows: DataFrame) -> DataFrame:
        """Places in the chunk: of the row, and of the row if it opens a run after the first row."""
        rows = rows.withColumn("__rn", F.row_number().over(w)).withColumn("__lag", F.lag(value).over(w))
        opens = (F.col("__rn") > 1) & starts(F.col("__lag"), F.col(value))
        return rows.withColumn("__open", F.when(opens, F.col("__rn"))).drop("__lag")

    held = F.struct(F.col(value).alias("v"))
    summary = inside(df.select(*dict.fromkeys([*keys, CHUNK, *order, value]))).groupBy(*keys, CHUNK).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max_by(held, F.col("__rn")).alias("__last"),
        F.min_by(held, F.col("__rn")).alias("__first"),
        F.max("__open").cast("bigint").alias("__begin"),
    )
    known = F.lit(False)
    if state is not None:
        earlier = state.withColumn(CHUNK, F.lit(-1).cast("bigint")).withColumn("__first", F.col("__last"))
        summary = earlier.unionByName(summary)
        known = F.col(CHUNK) == -1
    cw = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("__before", F.coalesce(F.sum("__n").over(cw), F.lit(0)))
    summary = summary.withColumn("__prev", F.last("__last", ignorenulls=True).over(cw))
    first = F.col("__prev").isNull() | starts(F.col("__prev.v"), F.col("__first.v"))
    summary = summary.withColumn("__opens", first)
    begin = (
        F.when(known, F.col("__begin"))
        .when(F.col("__begin").isNotNull(), F.col("__before") + F.col("__begin"))
        .when(F.col("__opens"), F.col("__before") + 1)
    )
    summary = summary.withColumn("__begin", begin)
    after = summary.groupBy(*keys).agg(
        F.sum("__n").alias("__n"),
        F.max_by("__last", CHUNK).alias("__last"),
        F.max("__begin").alias("__begin"),
    )
    before = summary.select(*keys, CHUNK, "__before", "__opens", F.max("__begin").over(cw).alias("__begin"))
    latest = F.max("__open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = with_summary(inside(df).withColumn("__latest", latest), before, [*keys, CHUNK])
    df = df.withColumn("__pos", (F.col("__before") + F.col("__rn")).cast("bigint"))
    first = F.when(F.col("__opens"), F.col("__before") + 1)
    df = df.withColumn("__start", F.coalesce(F.col("__before") + F.col("__latest"), first, F.col("__begin")))
    return df.drop("__rn", "__open", "__latest", "__opens", "__before", "__begin"), after
