"""Connected components of a distributed set of links, by alternating large and small stars.

A large star links every larger neighbour of a node to the smallest node around it; a small star
does so for the node and its smaller neighbours.  When nothing changes, every node is linked to the
smallest of its component.  Minima are aggregated before they are shuffled and joined back to the
links, so a node with very many links is spread; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(r)


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("w"), "m")
    return both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("w"), "m")
    joined = links.join(least, F.col("b") == F.col("w"))
    star = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionAll(least.select(F.col("m").alias("a"), F.col("w").alias("b")))
    return star.where("a < b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """member, root for each node of links (a, b) that isn't the smallest of its component."""
    now = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        after = materialize(_small(_large(now)))
        new = _state(after)
        now = after
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("member"), F.col("a").alias("root"))
