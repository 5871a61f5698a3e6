"""Connected components of a table of links, by alternating stars, without a central task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglane.llm.shared import store


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or the smaller) neighbours of each node with its least neighbour."""
    if larger:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Least neighbours are summed up before the shuffle, so a node with very many links does no harm; the join
    # back may be split by Spark where one node is that frequent.
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    pairs = both.join(least, "a")
    if larger:
        pairs = pairs.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        pairs = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return pairs.filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Rows ``node, root`` for every node that has a link to another; ``root`` is the least node it can reach.

    ``links`` has two columns of one ordered type, read as undirected links; rows with a null or with two equal
    ends are left out, repeated rows do no harm, no rows give no rows. Each round is written to shared storage.
    The number of rounds grows with the logarithm of the longest path.
    """
    a, b = links.columns[:2]
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    links = store(links, "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    last = state(links)
    if not last[0]:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(rounds):
        links = store(_stars(_stars(links, larger=True), larger=False), "links")
        now = state(links)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
