"""Alerts of very many rules: an index of what a line must contain finds the few rules worth trying on it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglane.functions.regex import required_literals, required_runs, translate
from loglane.operators.aggregates import alerts
from loglane.plans.lineage import broadcast_if_small, cut
from loglane.schema import require

# Lengths in bytes of the pieces of literals that are looked up; a literal has pieces of the largest that fits.
PIECES = (16, 8, 4, 2, 1)
# Rules without a literal that are tried on every line in one pass over the lines.
PASS_RULES = 200


def _parsed(rules: DataFrame) -> DataFrame:
    """``rule, pattern, java, literal, others`` for each literal of which a match must have one; a null literal if there is none.

    ``others`` are the further texts that a match of the literal's alternative has.
    """

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for rule, pattern in zip(batch["rule"], batch["pattern"], strict=True):
                if not rule:
                    raise ValueError("alerts: rule name must not be empty")
                java = translate(pattern).java
                literals, others = required_literals(pattern), {}
                # Alternatives with the same literal only share what all of them have.
                for literal, runs in zip(literals, required_runs(pattern) if literals else [], strict=True):
                    own = {r for r in runs if r and r not in literal}
                    others[literal] = others[literal] & own if literal in others else own
                out += [(rule, pattern, java, literal, sorted(rest)) for literal, rest in (others or {None: set()}).items()]
            yield pd.DataFrame(out, columns=["rule", "pattern", "java", "literal", "others"])

    schema = "rule string, pattern string, java string, literal string, others array<string>"
    return rules.select("rule", "pattern").mapInPandas(fn, schema)


def _pieces(text: Column, size: int) -> Column:
    """Hashes of all different runs of ``size`` bytes."""
    raw = F.encode(text, "UTF-8")
    last = F.octet_length(text) - size + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.substr(raw, i, F.lit(size)))))


def _size(literal: Column) -> Column:
    return reduce(lambda found, n: F.when(F.octet_length(literal) >= n, F.lit(n)).otherwise(found), reversed(PIECES), F.lit(0))


def literal_index(parsed: DataFrame) -> DataFrame:
    """``size, piece`` for each row that has a literal: its piece that fewest literals share."""
    rows = parsed.filter(F.col("literal").isNotNull()).withColumn("size", _size(F.col("literal")))
    sizes = [F.when(F.col("size") == n, _pieces(F.col("literal"), n)) for n in PIECES]
    pieces = rows.select("*", F.explode(F.coalesce(*sizes)).alias("piece"))
    shared = pieces.groupBy("size", "piece").agg(F.count(F.lit(1)).alias("n"))
    best = pieces.join(shared, ["size", "piece"]).groupBy("rule", "pattern", "java", "literal", "others", "size")
    return best.agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))


def table_alerts(df: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per line and matching rule of the table ``rule, pattern``: ``rule, service, line, seq`` (A4).

    Each rule's pattern is searched for texts that its matches must contain, and the piece of such a text that fewest
    rules share is put in an index. Lines look up their own pieces; only rules found there are tried, first by the whole
    literal, then by the pattern. So the work grows with lines and with what they match, not with lines times rules.
    Rules whose matches need not contain any text are tried on every line. Null texts match nothing, a rule that is
    there twice counts once, no rules give no rows; an invalid pattern fails the job.
    """
    require(df, "seq", "service", "text")
    lines = df.select("seq", "service", "text").filter(F.col("text").isNotNull())
    parsed = cut(_parsed(rules))
    index = cut(literal_index(parsed))
    keys = broadcast_if_small(cut(index.select("size", "piece").distinct()))

    # Lines meet the pieces of the index first, which many rules may share; only numbers are multiplied by the pieces of a
    # line. Texts come back once for each piece found, and a rule is tried where it meets the line, so that only hits leave
    # the join.
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())
    found = []
    for n in sizes:
        own = lines.select("seq", F.explode(_pieces(F.col("text"), n)).alias("piece"))
        found.append(own.join(keys.filter(F.col("size") == n), "piece").select("seq", "size", "piece"))
    out = []
    if found:
        pieces = reduce(DataFrame.unionByName, found).join(lines.select("seq", "text"), "seq").alias("l")
        tried = broadcast_if_small(index.select("size", "piece", "rule", "java", "literal", "others")).alias("r")
        hit = (
            (F.col("l.size") == F.col("r.size"))
            & (F.col("l.piece") == F.col("r.piece"))
            & F.contains(F.col("text"), F.col("literal"))
            & F.forall("others", lambda x: F.contains(F.col("text"), x))
            & F.regexp_like(F.col("text"), F.col("java"))
        )
        # A line may meet a rule by several alternatives.
        hits = pieces.join(tried, hit).select("rule", "seq").distinct()
        out.append(hits.join(lines, "seq").select("rule", "service", F.col("text").alias("line"), "seq"))
    rest = [(r["rule"], r["pattern"]) for r in parsed.filter(F.col("literal").isNull()).select("rule", "pattern").distinct().toLocalIterator()]
    for at in range(0, len(rest), PASS_RULES):
        out.append(alerts(lines, rest[at : at + PASS_RULES]))
    if not out:
        return lines.select(F.lit("").alias("rule"), "service", F.col("text").alias("line"), "seq").limit(0)
    return reduce(DataFrame.unionByName, out)
