"""Time layouts written by example (``2006-01-02 15:04:05``) as Spark datetime patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loglane.functions.regex import quote

# Layout names, the reference-time parts, the text they match and Spark's letters.
RFC3339 = "2006-01-02T15:04:05Z07:00"
DATE_TIME = "2006-01-02 15:04:05"
SHORT = "Jan 2 15:04:05"
DEFAULT_LAYOUTS = (RFC3339, DATE_TIME, SHORT)

PARTS = {
    "2006": (r"\d{4}", "yyyy"),
    "January": (r"(?i:January|February|March|April|May|June|July|August|September|October|November|December)", "MMMM"),
    "Jan": (r"(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", "MMM"),
    "01": (r"\d{2}", "MM"),
    "02": (r"\d{2}", "dd"),
    "_2": (r" ?\d{1,2}", "d"),
    "15": (r"\d{2}", "HH"),
    "03": (r"\d{2}", "hh"),
    "04": (r"\d{2}", "mm"),
    "05": (r"\d{2}(?:[.,]\d+)?", "ss"),
    "PM": (r"[AP]M", "a"),
    "Z07:00": (r"(?:Z|[+-]\d{2}:\d{2})", "XXX"),
    "-07:00": (r"[+-]\d{2}:\d{2}", "xxx"),
    "-0700": (r"[+-]\d{4}", "xx"),
    "1": (r"\d{1,2}", "M"),
    "2": (r"\d{1,2}", "d"),
    "3": (r"\d{1,2}", "h"),
    "4": (r"\d{1,2}", "m"),
    "5": (r"\d{1,2}(?:[.,]\d+)?", "s"),
}

_TOKEN = re.compile("|".join(re.escape(p) for p in sorted(PARTS, key=len, reverse=True)))


def _compile(layout: str) -> tuple[str, str, set[str]]:
    pattern, letters, used, at = r"\A", "", set(), 0

    def literal(text: str) -> None:
        nonlocal pattern, letters
        pattern += quote(text)
        letters += "".join(c if not c.isalpha() and c not in "'[]{}#" else f"'{c}'" for c in text)

    for m in _TOKEN.finditer(layout):
        literal(layout[at : m.start()])
        regex, code = PARTS[m[0]]
        pattern += regex
        letters += code + ("[.SSSSSSSSS]" if code in ("ss", "s") else "")
        used.add(code)
        at = m.end()
    literal(layout[at:])
    if not used:
        raise ValueError(f"time layout {layout!r} has no time part")
    return pattern, letters, used


def leading_time(text: Column, layouts: tuple[str, ...], year: int) -> Column:
    """The timestamp at the start of the text by the first layout that fits, else null.

    A layout without a year gets ``year``.
    """
    if not layouts:
        raise ValueError("at least one time layout is required")
    found = []
    for layout in layouts:
        pattern, letters, used = _compile(layout)
        # Months are matched in any case but parsed as written in the layout.
        head = F.regexp_extract(text, pattern, 0)
        head = F.regexp_replace(head, r"^(\D*)  (\d)", r"$1 $2") if "_2" in layout else head
        head = F.initcap(head) if used & {"MMM", "MMMM"} and "T" not in layout else head
        if "yyyy" not in used:
            head, letters = F.concat(F.lit(f"{year:04d} "), head), "yyyy " + letters
        found.append(F.try_to_timestamp(F.when(text.rlike(pattern), head), F.lit(letters)))
    return F.coalesce(*found)
