"""Operators whose result depends on the order of lines: per service or over the whole stream.

Every operator has a private form ``_name(df, ..., state)`` that returns the rows and the state
after them, used batch by batch by the streaming layer, and a public form for whole tables.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglane.functions.regex import matches, translate
from loglane.plans.chunks import (
    CHUNK,
    Carry,
    add_chunks,
    carry,
    clean,
    count_rows,
    keys_of,
    last_row,
    local,
    with_group,
    with_position,
    with_runs,
    with_summary,
)
from loglane.plans.lineage import broadcast_if_small, cut
from loglane.schema import duration_micros, from_micros, micros, require

State = dict[str, DataFrame]
ARRIVAL = ["seq"]
TIME = ["ts", "seq"]


def _at_least(name: str, value: int, least: int) -> int:
    if value < least:
        raise ValueError(f"{name} must be >= {least}, got {value}")
    return value


def _positive(name: str, value) -> int:
    us = duration_micros(value, name)
    if us <= 0:
        raise ValueError(f"{name} must be positive, got {value!r}")
    return us


# --- keeping and dropping by position -------------------------------------------------------


def _head(df, n, state=None, chunks=None):
    df, after = carry(
        add_chunks(df, ARRIVAL, chunks), "service", [count_rows()], (state or {}).get("rows")
    )
    # Chunks that start past the limit are cut before the shuffle of the window.
    df = df.filter(F.col("__n") < n)
    pos = F.col("__n") + F.row_number().over(local("service", ARRIVAL))
    return clean(df.withColumn("__pos", pos).filter(F.col("__pos") <= n)), {"rows": after}


# Up to this many rows per group Spark limits each task's part before the shuffle.
GROUP_LIMIT = 1000


def _first(df, n, order):
    """The first ``n`` rows of each service; no more than that many per service and task are shuffled."""
    pos = F.row_number().over(Window.partitionBy("service").orderBy(order))
    return df.withColumn("__pos", pos).filter(F.col("__pos") <= n).drop("__pos")


def head(df: DataFrame, n: int, *, chunks: int | None = None) -> DataFrame:
    """First ``n`` lines of each service."""
    require(df, "seq", "service")
    n = _at_least("n", n, 1)
    return _first(df, n, "seq") if n <= GROUP_LIMIT else _head(df, n, chunks=chunks)[0]


def ceiling(df: DataFrame, limit: int, *, chunks: int | None = None) -> DataFrame:
    """At most ``limit`` lines of each service (F8); the same rows as ``head``."""
    return head(df, limit, chunks=chunks)


def last_n(df: DataFrame, n: int = 0, *, chunks: int | None = None) -> DataFrame:
    """Last ``n`` lines of each service; 0 means 100."""
    require(df, "seq", "service")
    n = _at_least("n", n, 0) or 100
    if n <= GROUP_LIMIT:
        return _first(df, n, F.desc("seq"))
    df, _ = carry(add_chunks(df, ARRIVAL, chunks), "service", [count_rows()], reverse=True)
    df = df.filter(F.col("__n") < n)
    pos = F.col("__n") + F.row_number().over(local("service", ARRIVAL, reverse=True))
    return clean(df.withColumn("__pos", pos).filter(F.col("__pos") <= n))


def services(df: DataFrame) -> DataFrame:
    """Services with their number of lines (the listing that goes with ``last_n``)."""
    return df.groupBy("service").agg(F.count(F.lit(1)).alias("count"))


def _sample(df, n, group, state=None, chunks=None):
    df, after = with_position(df, ARRIVAL, group, (state or {}).get("rows"), chunks)
    return clean(df.filter(F.col("__pos") % n == 0)), {"rows": after}


def sample_per_service(df: DataFrame, n: int, *, chunks: int | None = None) -> DataFrame:
    """Every ``n``-th line of each service."""
    require(df, "seq", "service")
    return _sample(df, _at_least("n", n, 1), "service", chunks=chunks)[0]


def sample_overall(df: DataFrame, n: int, *, chunks: int | None = None) -> DataFrame:
    """Every ``n``-th line of the merged stream."""
    require(df, "seq")
    return _sample(df, _at_least("n", n, 1), None, chunks=chunks)[0]


# --- gate ------------------------------------------------------------------------------------


def _gate(df, opens, closes, initially_open, group, state=None, chunks=None):
    text = F.col("text")
    is_open = matches(text, opens)
    is_close = matches(text, closes) if closes else F.lit(False)
    df = add_chunks(df, ARRIVAL, chunks).withColumn("__opens", is_open)
    df = df.withColumn("__turn", F.when(is_close, False).when(is_open, True))
    turn_at = F.when(F.col("__turn").isNotNull(), F.col("seq"))
    turn = Carry("__before", F.max_by(F.col("__turn"), turn_at), "last")
    df, after = carry(df, group, [turn], (state or {}).get("turns"))
    w = local(group, ARRIVAL).rowsBetween(Window.unboundedPreceding, -1)
    was_open = F.coalesce(
        F.last("__turn", ignorenulls=True).over(w), F.col("__before"), F.lit(initially_open)
    )
    df = df.withColumn("__was", was_open)
    return clean(df.filter(F.col("__was") | F.col("__opens"))), {"turns": after}


def gate(
    df: DataFrame,
    opens: str,
    closes: str | None = None,
    *,
    initially_open: bool = False,
    per_service: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """Pass lines between an opening and a closing line, both included."""
    if not opens:
        raise ValueError("gate: the opening pattern must not be empty")
    translate(opens)
    if closes:
        translate(closes)
    require(df, "seq", "text")
    return _gate(df, opens, closes, initially_open, "service" if per_service else None, chunks=chunks)[0]


# --- repeats ---------------------------------------------------------------------------------


def _dedupe(df, state=None, chunks=None):
    df = _with_lag(add_chunks(df, ARRIVAL, chunks), ARRIVAL, "text")
    df, after = carry(
        df, "service", [last_row(F.col("text"), ARRIVAL, "__prev")], (state or {}).get("rows")
    )
    earlier = F.col("__prev").isNull() | ~F.col("__prev.v").eqNullSafe(F.col("text"))
    keep = F.when(F.col("__rn") > 1, ~F.col("__lag_text").eqNullSafe(F.col("text"))).otherwise(earlier)
    return clean(df.filter(keep)), {"rows": after}


def _with_lag(df, order, *columns):
    """Add ``__rn``, the place in the service's chunk, and ``__lag_<column>`` of the row before it there.

    Plain columns, so that no second copy of a text is sorted.
    """
    df, w = with_group(df, "service"), local("service", order)
    df = df.withColumn("__rn", F.row_number().over(w))
    return df.withColumns({f"__lag_{c}": F.lag(c).over(w) for c in columns})


def dedupe(df: DataFrame, *, chunks: int | None = None) -> DataFrame:
    """Drop a line equal to the previous line of its service."""
    require(df, "seq", "service", "text")
    return _dedupe(df, chunks=chunks)[0]


def with_previous(df: DataFrame, value: Column, name: str, *, chunks: int | None = None) -> DataFrame:
    """Add ``value`` of the service's previous line, null for its first line."""
    df = _with_lag(add_chunks(df.withColumn("__value", value), ARRIVAL, chunks), ARRIVAL, "__value")
    df, _ = carry(df, "service", [last_row(F.col("__value"), ARRIVAL, "__prev")])
    return clean(df.withColumn(name, F.when(F.col("__rn") > 1, F.col("__lag___value")).otherwise(F.col("__prev.v"))))


def _suppress(df, max_reps, state=None, chunks=None):
    changed = lambda prev, text: ~prev.eqNullSafe(text)
    df, after = with_runs(df, ARRIVAL, "service", "text", changed, (state or {}).get("rows"), chunks)
    return clean(df.filter(F.col("__pos") - F.col("__start") < max_reps)), {"rows": after}


def suppress(df: DataFrame, max_reps: int, *, chunks: int | None = None) -> DataFrame:
    """Keep the first ``max_reps`` lines of each run of identical lines of a service."""
    require(df, "seq", "service", "text")
    return _suppress(df, _at_least("max_reps", max_reps, 1), chunks=chunks)[0]


def _debounce(df, window_us, state=None, chunks=None):
    df = _with_lag(add_chunks(df.withColumn("__us", micros(df)), TIME, chunks), TIME, "text", "__us")
    value = F.struct(F.col("text").alias("text"), F.col("__us").alias("us"))
    df, after = carry(df, "service", [last_row(value, TIME, "__prev")], (state or {}).get("rows"))

    def new(text: Column, us: Column) -> Column:
        return ~text.eqNullSafe(F.col("text")) | (F.col("__us") - us >= window_us)

    earlier = F.col("__prev").isNull() | new(F.col("__prev.v.text"), F.col("__prev.v.us"))
    keep = F.when(F.col("__rn") > 1, new(F.col("__lag_text"), F.col("__lag___us"))).otherwise(earlier)
    return clean(df.filter(keep)), {"rows": after}


def debounce(df: DataFrame, window: timedelta | float | str, *, chunks: int | None = None) -> DataFrame:
    """Drop a repeat of a service's previous text that comes sooner than ``window`` after it."""
    require(df, "seq", "service", "text", "ts")
    return _debounce(df, _positive("window", window), chunks=chunks)[0]


# --- stamps that count -------------------------------------------------------------------------


def byte_length(text: Column) -> Column:
    """Bytes a line takes in its source, with the newline."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + F.lit(1)


def _byte_offset(df, state=None, chunks=None):
    df = with_group(add_chunks(df, ARRIVAL, chunks), "service")
    size = byte_length(F.col("text"))
    w = local("service", ARRIVAL).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum(size).over(w), F.lit(0)))
    df, after = carry(df, "service", [Carry("__n", F.sum(size), "sum")], (state or {}).get("rows"))
    return clean(df.withColumn("offset", F.col("__n") + F.col("__inside"))), {"rows": after}


def with_byte_offset(df: DataFrame, *, chunks: int | None = None) -> DataFrame:
    """Add ``offset``: bytes of the service's earlier lines, newlines included."""
    require(df, "seq", "service", "text")
    return _byte_offset(df, chunks=chunks)[0]


def stamp_offset(df: DataFrame, fmt: str = "", *, chunks: int | None = None) -> DataFrame:
    """Rewrite the text as ``fmt`` with the byte offset and the text."""
    fmt = fmt or "[%010d] %s"
    if "%s" not in fmt or "d" not in fmt.replace("%s", ""):
        raise ValueError("offset format needs one %d verb and one %s verb")
    out = with_byte_offset(df, chunks=chunks)
    return out.withColumn("text", F.format_string(fmt, "offset", "text")).drop("offset")


def final_offsets(df: DataFrame) -> DataFrame:
    """Total bytes per service."""
    require(df, "service", "text")
    return df.groupBy("service").agg(F.sum(byte_length(F.col("text"))).alias("offset"))


def _line_number(df, padding, state=None, chunks=None):
    df, after = with_position(df, ARRIVAL, "service", (state or {}).get("rows"), chunks)
    text = F.format_string(f"%0{padding}d %s", F.col("__pos"), F.col("text"))
    return clean(df.withColumn("text", F.when(F.col("text").isNotNull(), text))), {"rows": after}


def line_number(df: DataFrame, padding: int = 4, *, chunks: int | None = None) -> DataFrame:
    """Prepend the zero-padded line number within the service."""
    require(df, "seq", "service", "text")
    return _line_number(df, padding if padding >= 1 else 4, chunks=chunks)[0]


def _sequence(df, prefix, state=None, chunks=None):
    df, after = with_position(df, ARRIVAL, None, (state or {}).get("rows"), chunks)
    tag = F.concat(F.col("text"), F.lit(f" [{prefix}"), F.col("__pos").cast("string"), F.lit("]"))
    return clean(df.withColumn("text", tag)), {"rows": after}


def sequence(df: DataFrame, prefix: str = "#", *, chunks: int | None = None) -> DataFrame:
    """Append ``[#n]``, n counting the merged stream from 1 (P10)."""
    require(df, "seq", "text")
    return _sequence(df, prefix or "#", chunks=chunks)[0]


def current_sequence(df: DataFrame) -> DataFrame:
    """The last number given out by ``sequence`` (P10)."""
    return df.agg(F.count(F.lit(1)).alias("current"))


# --- service index -------------------------------------------------------------------------------

# Terminal colour codes given to services in order of first appearance.
PALETTE = (36, 32, 33, 35, 34, 31, 37)


def service_order(df: DataFrame, state: DataFrame | None = None, chunks: int | None = None) -> DataFrame:
    """One row per service: ``first_seq`` and its 0-based ``index`` by first appearance."""
    require(df, "seq", "service")
    first = df.groupBy("service").agg(F.min("seq").alias("first_seq"))
    if state is None:
        numbered = with_position(first, ["first_seq"], chunks=chunks)[0]
        return clean(numbered.withColumn("index", F.col("__pos") - 1))
    # Services of earlier batches keep their index; new ones follow.
    known = state.select("service", "first_seq", "index")
    seen = known.select("service").withColumn("__seen", F.lit(True))
    new = first.join(seen, first["service"].eqNullSafe(seen["service"]), "left_anti")
    numbered = with_position(new, ["first_seq"], chunks=chunks)[0]
    base = known.agg(F.coalesce(F.max("index") + 1, F.lit(0))).scalar()
    numbered = numbered.withColumn("index", base + F.col("__pos") - 1)
    return known.unionByName(clean(numbered))


def with_service_index(df: DataFrame, order: DataFrame | None = None, *, chunks: int | None = None) -> DataFrame:
    """Add ``index``: how many services appeared before this one."""
    # One small row per service.
    order = cut(service_order(df, chunks=chunks)) if order is None else order
    order = broadcast_if_small(order.select(F.col("service").alias("__svc"), "index"))
    return df.join(order, df["service"].eqNullSafe(F.col("__svc")), "left").drop("__svc")


def mark_service(
    df: DataFrame, palette: tuple[int, ...] = PALETTE, *, order: DataFrame | None = None, chunks: int | None = None
) -> DataFrame:
    """Wrap the text in the terminal colour of its service."""
    if not palette:
        raise ValueError("palette must not be empty")
    out = with_service_index(df, order, chunks=chunks)
    codes = F.array(*[F.lit(f"\x1b[{c}m") for c in palette])
    code = F.get(codes, (F.col("index") % len(palette)).cast("int"))
    return out.withColumn("text", F.concat(code, F.col("text"), F.lit("\x1b[0m"))).drop("index")


# --- order in time ----------------------------------------------------------------------------


def reorder(
    df: DataFrame,
    window: timedelta | float | str,
    extract=None,
    *,
    chunks: int | None = None,
) -> DataFrame:
    """Sort lines by extracted time inside consecutive arrival slots of ``window``.

    ``extract`` maps the text column to a timestamp column; where it is null the arrival time
    ``ts`` counts. ``seq`` becomes the new position, ``arrival_seq`` keeps the old one.
    """
    if extract is None or not callable(extract):
        raise ValueError("reorder: an extract function is required")
    require(df, "seq", "text", "ts")
    return sort_slots(with_slots(df, _positive("window", window), extract), chunks=chunks)[0]


def with_slots(df: DataFrame, window_us: int, extract, start: Column | None = None) -> DataFrame:
    """Add ``__slot`` (number of the arrival slot) and ``__at`` (the time to sort by inside it)."""
    at = F.unix_micros(extract(F.col("text")).cast("timestamp"))
    df = df.withColumn("__us", micros(df))
    # The stage starts with its first line: one number, found by a map-side combined minimum.
    start = df.agg(F.min("__us")).scalar() if start is None else start
    df = df.withColumn("__since", F.col("__us") - start)
    df = df.withColumn("__slot", F.expr(f"__since div {window_us}"))
    return df.withColumn("__at", F.coalesce(at, F.col("__us")))


def sort_slots(df: DataFrame, state: DataFrame | None = None, chunks: int | None = None):
    df, after = with_position(df, ["__slot", "__at", "seq"], None, state, chunks)
    out = df.withColumn("arrival_seq", F.col("seq")).withColumn("seq", F.col("__pos"))
    return clean(out), after


def pace(
    df: DataFrame,
    lines_per_second: int,
    *,
    per_service: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """When each line would leave a limiter of ``lines_per_second``.

    Adds ``paced_ts`` and ``delay_us``; 0 means no limit. Nothing is dropped.
    """
    require(df, "seq", "service", "ts")
    _at_least("lines_per_second", lines_per_second, 0)
    return _pace(df, lines_per_second, "service" if per_service else None, chunks=chunks)[0]


def throttle(df: DataFrame, lines_per_second: int, *, chunks: int | None = None) -> DataFrame:
    """``pace`` with at least one line per second."""
    return pace(df, _at_least("lines_per_second", lines_per_second, 1), chunks=chunks)


def _nanos(position: str, step: Column) -> Column:
    return (F.col(position).cast("decimal(19,0)") * step).cast("decimal(38,0)")


def _pace(df, rate, group, state=None, chunks=None):
    state = state or {}
    if rate == 0:
        return df.withColumn("paced_ts", F.col("ts")).withColumn("delay_us", F.lit(0).cast("bigint")), {}
    # Positions times steps pass the range of a bigint on long streams.
    step = F.lit(1_000_000_000 // rate).cast("decimal(18,0)")
    df = add_chunks(df.withColumn("__us", micros(df)), ARRIVAL, chunks)
    # A line leaves at the latest of: its own time, and one step after the line before it. With
    # time measured from an even schedule that is a running maximum. A chunk's maximum is taken
    # with positions counted inside it and moved when its place is known.
    w = local(group, ARRIVAL)
    df = with_group(df, group)
    lead = (F.col("__us").cast("decimal(38,0)") * 1000 - _nanos("__rn", step)).cast("decimal(38,0)")
    narrow = df.select(*keys_of(group), CHUNK, "seq", "__us").withColumn("__rn", F.row_number().over(w).cast("bigint"))
    summary = narrow.groupBy(*keys_of(group), CHUNK).agg(
        F.count(F.lit(1)).alias("__n"), F.max(lead).alias("__lead")
    )
    if "rows" in state:
        summary = state["rows"].withColumn(CHUNK, F.lit(-1).cast("bigint")).unionByName(summary)
    cw = Window.partitionBy(*keys_of(group)).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("__before", F.coalesce(F.sum("__n").over(cw), F.lit(0)))
    summary = summary.withColumn("__lead", (F.col("__lead") - _nanos("__before", step)).cast("decimal(38,0)"))
    after = summary.groupBy(*keys_of(group)).agg(F.sum("__n").alias("__n"), F.max("__lead").alias("__lead"))
    before = summary.select(*keys_of(group), CHUNK, "__before", F.max("__lead").over(cw).alias("__earlier"))
    df = with_summary(df, before, [*keys_of(group), CHUNK])
    df = df.withColumn("__rn", F.col("__before") + F.row_number().over(w))
    df = df.withColumn("__lead", F.max(lead).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    most = F.greatest(F.col("__lead"), F.col("__earlier"))
    df = df.withColumn("__nanos", (most + _nanos("__rn", step)).cast("decimal(38,0)"))
    df = df.withColumn("__paced", F.expr("__nanos div 1000"))
    out = df.withColumn("paced_ts", from_micros(df, F.col("__paced")))
    out = out.withColumn("delay_us", F.col("__paced") - F.col("__us"))
    return clean(out), {"rows": after}
