"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target of words: its weight's share of the mix, at most ``most`` times what it has, the excess
reshared by weight. A document's expected number of copies ``e`` is split into ``floor(e)`` certain copies and one
more with inclusion probability ``e - floor(e)``. For the latter, documents are ranked by the odds of a random
number over the odds of their inclusion probability, and the least ranks are taken until the words still due are
reached: a sample of fixed size (in words), with unequal probabilities where documents have weights.

The rank where a source is cut is found in three rounds of sums over 4096 cells of the rank, summed up before each
shuffle, then over the few ranks of the last cell. No source is sorted or gathered, and texts are never shuffled:
the cut, one row per source, is joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglane.llm.shared import store

WORD = r"[^\x20\x09-\x0D]+"
CELL_BITS = 12
RANK_BITS = 52
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number between 0 and 1 that depends on the seed, the id and the text alone."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << RANK_BITS))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    Weights repeat over the sources by code point, null last. Sources fill up to the level where the whole share is
    spent: those whose limit is least for their weight reach it first. One small row per source meets in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = (F.row_number().over(order) - 1) % len(weights)
    df = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1))
    df = df.withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("reach", F.col("limit") / F.col("weight"))
    everything = Window.partitionBy()
    by_reach = Window.orderBy("reach", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(by_reach.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_reach.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(share)
    df = df.withColumn("level", (total - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "level"))).over(everything)["level"]
    # Without such a source all reach their limit.
    target = F.coalesce(F.least("limit", F.col("weight") * level), F.col("limit"))
    return df.select("source", "source_size", target.alias("target"))


def _cell(level: int) -> Column:
    down = RANK_BITS - CELL_BITS * (level + 1)
    return F.shiftright("rank", down) if down else F.col("rank")


def _cuts(ranked: DataFrame) -> DataFrame:
    """``source, cut``: the last rank that each source takes, from ``source, rank, size, due``.

    Rows of one rank are taken or left together; the nearer of the two totals around the words due is taken.
    """
    here = ranked.filter("due > 0 and size > 0").withColumn("sum_before", F.lit(0).cast("bigint"))
    for level in range(4):
        unit = _cell(level) if level < 3 else F.col("rank")
        sums = here.withColumn("cell", unit).groupBy("source", "cell").agg(
            F.sum("size").alias("words"), F.first("due").alias("due"), F.first("sum_before").alias("sum_before")
        )
        line = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.col("sum_before") + F.sum("words").over(line))
        if level == 3:
            break
        # The cell in which the words due run out; the last one if they never do.
        past = F.when(F.col("upto") > F.col("due"), F.struct("cell", (F.col("upto") - F.col("words")).alias("before")))
        last = F.struct("cell", (F.col("upto") - F.col("words")).alias("before"))
        pick = sums.groupBy("source").agg(F.coalesce(F.min(past), F.max(last)).alias("p"))
        pick = pick.select(F.col("source").alias("at"), F.col("p.cell").alias("cell_at"), F.col("p.before").alias("before"))
        here = here.withColumn("cell", unit).join(pick, F.col("source").eqNullSafe(F.col("at")) & (F.col("cell") == F.col("cell_at")))
        here = here.select("source", "rank", "size", "due", F.col("before").alias("sum_before"))
    short = F.col("due") - (F.col("upto") - F.col("words"))
    taken = F.when((F.col("upto") <= F.col("due")) | (F.col("upto") - F.col("due") < short), F.col("cell"))
    # Nothing of the last cell taken: all ranks below it are.
    return sums.groupBy("source").agg(F.coalesce(F.max(taken), F.min("cell") - 1).alias("cut"))


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix", weight: str | None = None,
) -> DataFrame:
    """Rows ``row`` (all columns of the document), ``size, source_size, target, copies``, one per row of ``docs``.

    ``docs`` has ``doc_id, text, source``; further columns of any name travel in ``row``. ``size`` counts the words
    of the text (null: 0). ``share`` is the mix's size over the size of all documents, ``most`` (1 to 2) the most
    copies of a document and of a source. ``weight`` may name a positive column by which documents of a source
    are preferred: expected copies are in proportion to it, up to ``most``; null or not positive counts as never.
    Reruns agree. Identical rows have one rank and the same copies. A null source is a source of its own, after all
    others. Documents without words take part but add nothing. No rows give no rows.
    """
    if not weights or min(weights) <= 0 or not 0 < share or not 1 <= most <= 2:
        raise ValueError("weights and share must be positive, most from 1 to 2")
    own = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(f"row.`{weight}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select(
        "row", F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"),
        uniform(F.col("row.doc_id"), F.col("row.text"), seed).alias("u"), own.alias("own"),
    )
    narrow = store(rows.select("source", "size", "u", "own"), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("own") * F.col("size")).alias("pull"))
    goal = targets(sizes.select("source", "source_size"), weights, share, most)
    goal = goal.join(sizes.select(F.col("source").alias("at"), "pull"), F.col("source").eqNullSafe(F.col("at"))).drop("at")
    rate = F.when(F.col("pull") > 0, F.col("target") / F.col("pull")).otherwise(0.0)
    goal = store(goal.select(F.col("source").alias("at"), "source_size", "target", rate.alias("rate")), "targets")

    def ranked(df: DataFrame) -> DataFrame:
        df = df.join(goal, F.col("source").eqNullSafe(F.col("at"))).drop("at")
        expected = F.least(F.col("rate") * F.col("own"), F.lit(most))
        sure = F.floor(expected)
        odds = F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")))
        rank = F.floor(odds / (1 + odds) * F.lit(float(1 << RANK_BITS)))
        df = df.withColumn("sure", sure).withColumn("p", expected - sure)
        # Zero probability: never taken beyond the certain copies.
        return df.withColumn("rank", F.when(F.col("p") > 0, rank))

    draw = ranked(narrow)
    # Words still due after the certain copies.
    due = draw.groupBy("source").agg((F.first("target") - F.sum(F.col("sure") * F.col("size"))).alias("due"))
    due = due.select(F.col("source").alias("at"), "due")
    draw = draw.filter("rank is not null").join(due, F.col("source").eqNullSafe(F.col("at")))
    cuts = store(_cuts(draw.select("source", "rank", "size", "due")), "cuts")
    out = ranked(rows).join(cuts.withColumnRenamed("source", "at"), F.col("source").eqNullSafe(F.col("at")), "left")
    extra = F.when(F.col("rank") <= F.col("cut"), 1).otherwise(0)
    return out.select("row", "size", "source_size", "target", (F.col("sure") + extra).cast("int").alias("copies"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with the columns of ``docs``."""
    rows = mixed(docs, **options).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("row.*")


# The query's result in SQL: the same ranks, sorted as a whole.
SQL = r"""
WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
        / 4503599627370496.0::DOUBLE AS u FROM documents),
  sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
  weighted AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE
    AS weight FROM sizes),
  reach AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS reach FROM weighted),
  levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM reach),
  goal AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, reach) FROM levels WHERE level <= reach)), cap)
    AS target FROM levels),
  rated AS (SELECT b.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size::DOUBLE, 2.0) ELSE 0 END AS e
    FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source),
  odds AS (SELECT *, floor(e) AS sure, CASE WHEN e > floor(e) THEN u / (1 - u) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q FROM rated),
  ranks AS (SELECT *, floor(q / (1 + q) * 4503599627370496.0::DOUBLE) AS rank, target - sure * source_size AS due FROM odds),
  upto AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, rank) AS words FROM ranks)
SELECT doc_id, size, source_size, target, (size * (sure + CASE WHEN q IS NOT NULL AND due > 0
    AND (upto <= due OR upto - due < due - (upto - words)) THEN 1 ELSE 0 END))::BIGINT AS taken FROM upto
"""
