"""Connected components of a link table by alternating stars.

Each round is two aggregations and two joins over the links; no link list,
component or label set ever reaches the driver, only a count and a checksum
that tell whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardspark.llm.scratch import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour."""
    both = e.union(e.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    down = e.join(least, "a")
    return down.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("p")).select("p.*").where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` has two columns of the same ordered type.  Returns ``a`` (a
    node) and ``b`` (the smallest node of its component), without the smallest
    nodes themselves."""
    x, y = links.columns
    e = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a <> b").distinct()
    e = scratch.table(e, "links")
    state = None
    while True:
        found = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            return e
        state = tuple(found)
        star = scratch.table(_large_star(e), "large-star")
        new = scratch.table(_small_star(star), "small-star")
        scratch.drop(e, star)
        e = new
