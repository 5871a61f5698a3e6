"""Line-by-line rewriting of the text, and fields read from it. Null text stays null."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglane.functions import text as tx
from loglane.functions.json_indent import indent_json
from loglane.functions.regex import (
    literal_replacement,
    quote,
    replace_all,
    translate,
)
from loglane.schema import micros, require


def _set(df: DataFrame, text: Column) -> DataFrame:
    require(df, "text")
    return df.withColumn("text", text)


def label(df: DataFrame, service: str) -> DataFrame:
    """Give every line the same service."""
    if not service:
        raise ValueError("label: service must not be empty")
    return df.withColumn("service", F.lit(service))


def prefix(df: DataFrame, text: str) -> DataFrame:
    """Prepend a constant."""
    if not text:
        raise ValueError("prefix must not be empty")
    return _set(df, F.concat(F.lit(text), F.col("text")))


def indent(df: DataFrame, text: str = "  ") -> DataFrame:
    """Prepend an indent."""
    return prefix(df, text)


def bracket(df: DataFrame, opening: str, closing: str) -> DataFrame:
    """Wrap the text between two constants."""
    if not opening and not closing:
        raise ValueError("bracket: opening and closing must not both be empty")
    return _set(df, F.concat(F.lit(opening), F.col("text"), F.lit(closing)))


def normalize(
    df: DataFrame, *, trim: bool = False, collapse_spaces: bool = False, lowercase: bool = False
) -> DataFrame:
    """Trim, then collapse white space, then lower case, as chosen."""
    if not (trim or collapse_spaces or lowercase):
        raise ValueError("normalize: at least one option must be enabled")
    text = F.col("text")
    if trim:
        text = tx.strip_space(text)
    if collapse_spaces:
        text = F.regexp_replace(text, F.lit(r"[\t\n\f\r ]+"), F.lit(" "))
    if lowercase:
        text = F.lower(text)
    return _set(df, text)


def strip(df: DataFrame, *, ansi: bool = False, whitespace: bool = False) -> DataFrame:
    """Remove terminal control codes, then outer white space, as chosen."""
    if not (ansi or whitespace):
        raise ValueError("strip: at least one option must be enabled")
    text = F.col("text")
    if ansi:
        text = tx.strip_control_codes(text)
    if whitespace:
        text = tx.strip_space(text)
    return _set(df, text)


def strip_colours(df: DataFrame) -> DataFrame:
    """Remove colour codes only."""
    return _set(df, tx.strip_colour_codes(F.col("text")))


def mask(df: DataFrame, patterns: list[str], placeholder: str = "[MASKED]") -> DataFrame:
    """Replace every match of each pattern by the placeholder, in list order (P5)."""
    if not patterns:
        raise ValueError("mask: at least one pattern is required")
    placeholder = placeholder or "[MASKED]"
    return redact(df, [(p, placeholder) for p in patterns])


def redact(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Apply ``(pattern, replacement)`` rules in order; replacements may use groups."""
    return _set(df, reduce(lambda t, r: replace_all(t, *r), rules, F.col("text")))


def truncate(df: DataFrame, max_bytes: int = 1024, suffix: str = "...") -> DataFrame:
    """Clip texts over ``max_bytes`` bytes and append ``suffix``."""
    if max_bytes < 0:
        raise ValueError(f"truncate: max_bytes must be >= 0, got {max_bytes}")
    return _set(df, tx.truncate_bytes(F.col("text"), max_bytes or 1024, suffix or "..."))


def stamp_time(df: DataFrame, fmt: str = "rfc3339", *, started: datetime | None = None) -> DataFrame:
    """Prepend the line's time: ``rfc3339``, ``unix``, ``kitchen``, or ``relative`` to ``started``."""
    require(df, "text", "ts")
    ts = F.col("ts")
    if fmt == "rfc3339":
        shown = tx.rfc3339(ts)
    elif fmt == "unix":
        shown = F.unix_seconds(ts.cast("timestamp")).cast("string")
    elif fmt == "kitchen":
        shown = F.date_format(ts, "h:mma")
    elif fmt == "relative":
        if started is None:
            raise ValueError("stamp_time: relative needs a started time")
        start = started if started.tzinfo else started.replace(tzinfo=timezone.utc)
        shown = F.concat(F.lit("+"), tx.duration_text(micros(df) - F.unix_micros(F.lit(start))))
    else:
        raise ValueError(f"stamp_time: unknown format {fmt!r}")
    return _set(df, F.concat(shown, F.lit(" "), F.col("text")))


def line_format(df: DataFrame, template: str, *, now: bool = False) -> DataFrame:
    """Fill ``{service}``, ``{text}`` and ``{time}`` of a template, in this order."""
    if not any(p in template for p in ("{service}", "{text}", "{time}")):
        raise ValueError("line_format: template needs {service}, {text} or {time}")
    require(df, "service", "text", "ts")
    time = F.current_timestamp() if now else F.col("ts")
    out = F.replace(F.lit(template), F.lit("{service}"), F.coalesce(F.col("service"), F.lit("")))
    out = F.replace(out, F.lit("{text}"), F.col("text"))
    return _set(df, F.replace(out, F.lit("{time}"), F.coalesce(tx.rfc3339(time), F.lit(""))))


def columns(df: DataFrame, delimiter: str, widths: list[int]) -> DataFrame:
    """Pad the i-th field to the i-th width; further fields follow after the delimiter."""
    if not delimiter:
        raise ValueError("columns: delimiter must not be empty")
    if not widths or any(w <= 0 for w in widths):
        raise ValueError("columns: widths must be a non-empty list of positive numbers")
    parts = F.split(F.col("text"), quote(delimiter), -1)
    width = F.array(*[F.lit(w) for w in widths])

    def field(part: Column, i: Column) -> Column:
        room = F.greatest(F.get(width, i) - F.char_length(part), F.lit(0))
        padded = F.concat(part, F.repeat(F.lit(" "), room))
        return F.when(i < len(widths), padded).otherwise(F.concat(F.lit(delimiter), part))

    return _set(df, F.array_join(F.transform(parts, field), ""))


def highlight(
    df: DataFrame, rules: list[tuple[str, str]], closing: str = "\x1b[0m", *, codes: bool = True
) -> DataFrame:
    """Wrap every match of each ``(pattern, mark)`` rule, in order.

    With ``codes`` a mark is a terminal colour number such as ``31``; otherwise it is the opening
    text itself.
    """
    text = F.col("text")
    for pattern, mark in rules:
        opening = f"\x1b[{mark}m" if codes else mark
        wrapped = literal_replacement(opening) + "$0" + literal_replacement(closing)
        text = F.regexp_replace(text, F.lit(translate(pattern).replacing), F.lit(wrapped))
    return _set(df, text)


def extract_fields(df: DataFrame, fields: list[str], *, json: bool = False) -> DataFrame:
    """Add ``fields``: a map of the wanted key=value or JSON fields found in the text."""
    require(df, "text")
    return df.withColumn("fields", _field_map(fields, json))


def _field_map(fields: list[str], json: bool) -> Column:
    if not fields:
        raise ValueError("extract_fields: at least one field is required")
    read = tx.json_field if json else tx.key_value_field
    entries = [F.struct(F.lit(f).alias("key"), read(F.col("text"), f).alias("value")) for f in dict.fromkeys(fields)]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def annotate_fields(df: DataFrame, fields: list[str], *, json: bool = False) -> DataFrame:
    """Prepend the fields found as ``k=v`` pairs, in the order asked for."""
    found = F.map_entries(_field_map(fields, json))
    pairs = F.transform(found, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    text = F.array_join(F.concat(pairs, F.array(F.col("text"))), " ")
    return _set(df, F.when(F.col("text").isNotNull(), text))


def json_pretty(df: DataFrame, indent: str = "  ") -> DataFrame:
    """Re-indent texts that are JSON objects or arrays; leave all others as they are."""
    require(df, "text")
    indent = indent or "  "

    @F.pandas_udf("string")
    def pretty(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: indent_json(t, indent), na_action="ignore")

    # Only texts that can be JSON go to Python, in Arrow batches.
    candidate = F.col("text").rlike(r"(?U)^\s*[{\[]")
    return _set(df, F.when(candidate, pretty(F.when(candidate, F.col("text")))).otherwise(F.col("text")))


def parse_json(df: DataFrame) -> DataFrame:
    """Add ``json`` (VARIANT) and ``is_json`` for texts that are JSON objects or arrays.

    ``json`` is null for texts that are not, and where an object has a key twice, which VARIANT does not hold.
    """
    require(df, "text")
    is_json = F.coalesce(tx.is_json_container(F.col("text")), F.lit(False))
    df = df.withColumn("is_json", is_json)
    return df.withColumn("json", F.when(F.col("is_json"), F.try_parse_json(tx.strip_space(F.col("text")))))


def render(df: DataFrame) -> DataFrame:
    """Add ``output``: time, service padded to 15, text, and ``[DRIFT]`` where ``drift`` holds."""
    require(df, "service", "text", "ts")
    body = F.regexp_replace(F.col("text"), F.lit(r"[\r\n]+\z"), F.lit(""))
    line = F.concat_ws(
        " ",
        tx.rfc3339(F.col("ts")),
        tx.pad_right(F.coalesce(F.col("service"), F.lit("")), 15),
        F.coalesce(body, F.lit("")),
    )
    if "drift" in df.columns:
        line = F.concat(line, F.when(F.col("drift"), F.lit(" [DRIFT]")).otherwise(F.lit("")))
    return df.withColumn("output", line)


def with_normal_form(df: DataFrame) -> DataFrame:
    """Add ``norm``, the form in which lines are compared (P20)."""
    require(df, "text")
    return df.withColumn("norm", tx.normal_form(F.col("text")))
