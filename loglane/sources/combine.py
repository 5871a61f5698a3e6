"""Putting log tables or streams together, and giving one to several consumers."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame

from loglane.operators.transforms import label
from loglane.plans.lineage import cut


def merge(*dfs: DataFrame) -> DataFrame:
    """All lines of all inputs (S4). For an order, give the inputs one numbering ``seq``."""
    if not dfs:
        raise ValueError("merge: at least one source is required")
    return reduce(DataFrame.unionByName, dfs)


def label_all(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Merge inputs, each under its own service name."""
    if not sources:
        raise ValueError("label_all: at least one source is required")
    return merge(*[label(df, name) for name, df in sources.items()])


def fan_out(df: DataFrame, *consumers: Callable[[DataFrame], object]) -> list:
    """Give every consumer every line (S11); what they read in common is computed once.

    The lines are written to the shared checkpoint folder, so lazy consumers may read them at any later time.
    """
    if not consumers:
        raise ValueError("fan_out: at least one consumer is required")
    df = cut(df)
    return [consume(df) for consume in consumers]
