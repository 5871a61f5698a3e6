"""Column functions on line text. All stay inside Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Terminal control sequences, and the shorter set that only changes colours.
CONTROL_CODES = r"\x1B\[[0-9;]*[a-zA-Z]"
COLOUR_CODES = r"\x1B\[[0-9;]*m"
# Fixed value: a key=value pair, the value bare or in double quotes.
KEY_VALUE = r'(\w+)=("[^"]*"|[^\t\n\f\r ]+)'

# Unicode white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip_space(text: Column) -> Column:
    """Trim Unicode white space at both ends (Spark's plain ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_control_codes(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL_CODES), F.lit(""))


def strip_colour_codes(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(COLOUR_CODES), F.lit(""))


def normal_form(text: Column) -> Column:
    """The form in which lines are compared for drift: lower case, trimmed (P20)."""
    return strip_space(F.lower(text))


def byte_bigrams(text: Column) -> Column:
    """Array with the hexadecimal form of each pair of neighbouring bytes, in order."""
    # One pass cuts the text into bytes; looking each pair up by its place would rescan the text.
    code = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    pairs = F.octet_length(text) - F.lit(1)
    grams = F.zip_with(F.slice(code, F.lit(1), pairs), F.slice(code, F.lit(2), pairs), lambda x, y: F.concat(x, y))
    return F.when(pairs >= 1, grams).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Bigram similarity of two texts.

    Twice the shared bigrams, counted with repeats, over the number of *distinct* bigrams of both,
    so it can exceed 1; equal texts give 1, a text under two bytes 0.
    """

    def times(grams: Column, g: Column) -> Column:
        return F.size(F.filter(grams, lambda x: x == g))

    def score(both: Column) -> Column:
        ga, gb = both["a"], both["b"]
        shared = F.aggregate(
            F.array_intersect(ga, gb),
            F.lit(0),
            lambda acc, g: acc + F.least(times(ga, g), times(gb, g)),
        )
        distinct = F.size(F.array_distinct(ga)) + F.size(F.array_distinct(gb))
        return (shared * 2).cast("double") / distinct.cast("double")

    # An array of one element, so that the bigrams are computed once and not for every use.
    once = F.array(F.struct(byte_bigrams(a).alias("a"), byte_bigrams(b).alias("b")))
    return (
        F.when(a == b, F.lit(1.0))
        .when((F.octet_length(a) < 2) | (F.octet_length(b) < 2), F.lit(0.0))
        .otherwise(F.get(F.transform(once, score), F.lit(0)))
    )


def truncate_bytes(text: Column, max_bytes: int, suffix: str) -> Column:
    """Clip text over ``max_bytes`` bytes, never inside a character, and add ``suffix``."""
    raw = F.encode(text, "UTF-8")
    code = F.hex(raw)

    def starts_character(k: int) -> Column:
        # The k-th byte after the cut is not a continuation byte (10xxxxxx).
        top = F.substring(code, 2 * (max_bytes - k) + 1, 1)
        return ~top.isin("8", "9", "A", "B")

    cut = F.lit(max(max_bytes - 3, 0))
    for k in range(min(2, max_bytes), -1, -1):
        cut = F.when(starts_character(k), F.lit(max_bytes - k)).otherwise(cut)
    clipped = F.decode(F.substring(raw, F.lit(1), cut), "UTF-8")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(
        F.concat(clipped, F.lit(suffix))
    )


def pad_right(text: Column, width: int) -> Column:
    """Pad to ``width`` characters, never cut."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.char_length(text), F.lit(0))))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def duration_text(us: Column) -> Column:
    """``1h2m3.5s``, ``5ms``, ``0s``: a span of microseconds, cut to whole milliseconds."""
    ms = F.when(us < 0, -F.floor(-us / 1000)).otherwise(F.floor(us / 1000)).cast("bigint")
    sign, ms = F.when(ms < 0, F.lit("-")).otherwise(F.lit("")), F.abs(ms)
    hours = F.floor(ms / 3_600_000)
    minutes = F.floor(ms / 60_000) % 60
    seconds = F.floor(ms / 1000) % 60
    fraction = F.rtrim(F.format_string("%03d", ms % 1000), F.lit("0"))
    shown = F.concat(
        seconds.cast("string"),
        F.when(ms % 1000 == 0, F.lit("")).otherwise(F.concat(F.lit("."), fraction)),
        F.lit("s"),
    )
    h = F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.lit(""))
    m = F.when(ms >= 60_000, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(F.lit(""))
    return (
        F.when(ms == 0, F.lit("0s"))
        .when(ms < 1000, F.concat(sign, ms.cast("string"), F.lit("ms")))
        .otherwise(F.concat(sign, h, m, shown))
    )


def key_value_field(text: Column, name: str) -> Column:
    """The last ``name=value`` in the text, quotes trimmed, or null."""
    keys = F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(2))
    hits = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda kv: kv["k"] == name)
    return F.regexp_replace(F.try_element_at(hits, F.lit(-1))["v"], F.lit(r'^"+|"+\z'), F.lit(""))


# Marks that stand for an escape, a string and a value while JSON is checked; no JSON has these characters itself.
_ESCAPE, _STRING, _VALUE = "\x01", "\x02", "\x03"
# What JSON allows as escapes, numbers and names.
JSON_ESCAPE = r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})'
JSON_SCALAR = r"(?:-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?(?:[eE][+-]?[0-9]++)?|true|false|null)"


def is_json_container(text: Column) -> Column:
    """The text, without outer white space, is a JSON object or array; null for null.

    Strings and other scalars become marks, and then containers of marks alone become marks, innermost first, until
    nothing changes: only JSON ends as one mark. Keys may repeat.
    """
    body = strip_space(text)
    # Control characters other than white space have no place in JSON, so they can serve as marks.
    plain = ~body.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") & body.rlike(r"\A[{\[]")
    marked = F.regexp_replace(body, F.lit(JSON_ESCAPE), F.lit(_ESCAPE))
    marked = F.regexp_replace(marked, F.lit(r'"[^"\\\t\n\r]*+"'), F.lit(_STRING))
    marked = F.regexp_replace(marked, F.lit(rf"(?<![^\[,:\t\n\r ]){JSON_SCALAR}(?![^\],}}\t\n\r ])"), F.lit(_VALUE))
    marked = F.regexp_replace(marked, F.lit(r"[\t\n\r ]++"), F.lit(""))
    any_value = f"[{_STRING}{_VALUE}]"
    array = rf"\[(?:{any_value}(?:,{any_value})*+)?+\]"
    entry = f"{_STRING}:{any_value}"
    container = F.lit(rf"{array}|\{{(?:{entry}(?:,{entry})*+)?+\}}")
    # One round for each level would do; their number is at most that of containers, and idle rounds cost little.
    levels = F.regexp_count(marked, F.lit(r"[\[{]"))
    rounds = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    left = F.aggregate(rounds, marked, lambda acc, _: F.when(acc == _VALUE, acc).otherwise(F.regexp_replace(acc, container, F.lit(_VALUE))))
    return F.when(plain, left == _VALUE).when(text.isNotNull(), F.lit(False))


def json_field(text: Column, name: str) -> Column:
    """A top-level field of a JSON object as text; null if absent, null or not an object; the last of several."""
    body = strip_space(text)
    value = F.from_json(body, T.StructType([T.StructField(name, T.StringType())])).getField(name)
    return F.when(is_json_container(text) & body.startswith("{"), value)
