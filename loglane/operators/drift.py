"""Lines that are new: never seen before, exactly or nearly, in a stream, a snapshot or a service."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglane.functions.layouts import DEFAULT_LAYOUTS
from loglane.functions.text import normal_form
from loglane.operators.fuzzy import fuzzy_firsts
from loglane.plans.lineage import broadcast_if_small, cut
from loglane.operators.filters import cutoff_time
from loglane.operators.filters import since as keep_since
from loglane.schema import require

MODES = ("none", "uniq", "fuzzy")


def drift(df: DataFrame, mode: str = "uniq", threshold: float = 0.8, *, scope: str = "all") -> DataFrame:
    """Add ``drift``: the line is new among the lines before it.

    ``none`` marks nothing; ``fuzzy`` asks for similarity below ``threshold``; anything else is
    ``uniq``. ``scope='other_services'`` (uniq only) compares with other services' lines alone.
    """
    require(df, "seq", "service", "text")
    if scope not in ("all", "other_services"):
        raise ValueError(f"drift: unknown scope {scope!r}")
    if mode == "none":
        return df.withColumn("drift", F.lit(False))
    if mode == "fuzzy":
        if scope != "all":
            raise ValueError("drift: scope 'other_services' is for uniq mode")
        return drift_fuzzy(df, threshold)
    return drift_uniq(df) if scope == "all" else _drift_other_services(df)


def first_seen(df: DataFrame) -> DataFrame:
    """Distinct normal forms with the ``seq`` of their first line: ``norm, first_seq``."""
    norm = F.coalesce(normal_form(F.col("text")), F.lit(""))
    return df.groupBy(norm.alias("norm")).agg(F.min("seq").alias("first_seq"))


def mark_firsts(df: DataFrame, firsts: DataFrame) -> DataFrame:
    """``drift`` where ``seq`` is among ``firsts.first_seq``.

    The numbers are found first and kept. If they are few, the lines need no shuffle at all;
    otherwise the join is on ``seq``, unique on both sides, so a text that fills a third of the
    table does no harm.
    """
    firsts = cut(firsts.select(F.col("first_seq").alias("seq")))
    firsts = broadcast_if_small(firsts.withColumn("__new", F.lit(True)))
    out = df.join(firsts, "seq", "left")
    return out.withColumn("drift", F.coalesce("__new", F.lit(False))).drop("__new")


def drift_uniq(df: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Lines whose normal form never came before, in any service.

    ``seen`` holds forms (``norm``) known from earlier.
    """
    firsts = first_seen(df)
    if seen is not None:
        firsts = firsts.join(seen.select("norm"), "norm", "left_anti")
    return mark_firsts(df, firsts)


def _drift_other_services(df: DataFrame) -> DataFrame:
    """New if no *other* service had the form before: decided by the two earliest services."""
    norm = F.coalesce(normal_form(F.col("text")), F.lit(""))
    service = F.coalesce(F.to_json(F.struct("service")), F.lit(""))
    firsts = df.groupBy(norm.alias("norm"), service.alias("svc")).agg(F.min("seq").alias("at"))
    earliest = F.slice(F.array_sort(F.collect_list(F.struct("at", "svc"))), 1, 2)
    # Two rows per form are enough: the earliest service, and the earliest other one.
    w = Window.partitionBy("norm").orderBy("at")
    two = firsts.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 2)
    two = two.groupBy("norm").agg(earliest.alias("e"))
    two = two.select("norm", F.col("e")[0]["svc"].alias("__svc1"), F.col("e")[0]["at"].alias("__at1"),
                     F.get("e", F.lit(1))["at"].alias("__at2"))
    out = df.withColumn("norm", norm).withColumn("__svc", service).join(two, "norm", "left")
    other = F.when(F.col("__svc") == F.col("__svc1"), F.col("__at2")).otherwise(F.col("__at1"))
    new = other.isNull() | (other >= F.col("seq"))
    return out.withColumn("drift", new).drop("norm", "__svc", "__svc1", "__at1", "__at2")


def drift_fuzzy(df: DataFrame, threshold: float = 0.8, seen: DataFrame | None = None) -> DataFrame:
    """Lines unlike every earlier form: bigram similarity below ``threshold`` to all of them.

    ``seen`` holds forms (``norm, first_seq``) known from earlier; their ``first_seq`` must be
    below every ``seq``. On long texts the measure exceeds 1 for most pairs (see ``dice``), so
    clip them first (``truncate``).
    """
    firsts = first_seen(df)
    if seen is not None:
        firsts = cut(firsts.join(seen.select("norm"), "norm", "left_anti"))
    return mark_firsts(df, unlike(firsts, threshold, seen))


def unlike(new: DataFrame, threshold: float, seen: DataFrame | None) -> DataFrame:
    """Forms among ``new`` that are like none before them, those ``seen`` earlier included; both ``norm, first_seq``.

    With ``seen``, ``new`` should be cheap to read again and hold no form of it.
    """
    if seen is None:
        return fuzzy_firsts(new, threshold)
    start = new.agg(F.min("first_seq")).first()[0]
    # Without new forms there is nothing to look for.
    if start is None:
        return new
    return fuzzy_firsts(new.unionByName(seen.select("norm", "first_seq")), threshold, start)


# --- against a snapshot, between two services -------------------------------------------------


def baseline_drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Lines of ``current`` whose service and normal form the baseline does not have.

    Call it the other way round for lines that are gone.
    """
    for df in (current, baseline):
        require(df, "service", "text")

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("__svc", F.coalesce("service", F.lit(""))).withColumn(
            "__svc_null", F.col("service").isNull()
        ).withColumn("__norm", F.coalesce(normal_form(F.col("text")), F.lit("")))

    keys = ["__svc", "__svc_null", "__norm"]
    # The baseline shrinks to its distinct keys before it is shuffled.
    known = keyed(baseline).select(*keys).distinct()
    return keyed(current).join(known, keys, "left_anti").drop(*keys)


def two_service_diff(
    df: DataFrame,
    left: str,
    right: str,
    cutoff: datetime | timedelta | str | None = None,
    *,
    layouts: tuple[str, ...] = DEFAULT_LAYOUTS,
    by_ts: bool = False,
    now: datetime | None = None,
) -> DataFrame:
    """Normal forms of two services with counts: ``norm, left_count, right_count, side``.

    ``side`` is ``left``, ``right`` or ``both``. With ``cutoff``, a time or a duration before ``now`` (see
    ``since``), only lines since then count, by their leading timestamp, or by ``ts`` with ``by_ts``.
    """
    require(df, "service", "text")
    if not left or not right or left == right:
        raise ValueError("two_service_diff: two different services are required")
    df = df.filter(F.col("service").isin(left, right))
    if cutoff is not None:
        cutoff = cutoff_time(cutoff, now)
        df = df.filter(F.col("ts") >= F.lit(cutoff).cast(df.schema["ts"].dataType)) if by_ts else keep_since(df, cutoff, layouts)

    def count_of(service: str) -> Column:
        return F.count(F.when(F.col("service") == service, F.lit(1)))

    # One map-side combined groupBy serves as the full outer join of the two sides.
    norm = F.coalesce(normal_form(F.col("text")), F.lit(""))
    counts = df.groupBy(norm.alias("norm")).agg(
        count_of(left).alias("left_count"), count_of(right).alias("right_count")
    )
    side = (
        F.when(F.col("right_count") == 0, "left").when(F.col("left_count") == 0, "right").otherwise("both")
    )
    return counts.withColumn("side", side)
