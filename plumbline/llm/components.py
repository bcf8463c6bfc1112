"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import discard, materialise


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    return _neighbours(edges).where(F.col("b") > F.col("a")).join(least, "a").select(F.col("m").alias("a"), "b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id hangs on one smaller id, and none hangs on one that hangs itself."""
    ends = edges.select(F.col("b").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("a").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
    return ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.max("holds").alias("holds")).where((F.col("n") > 1) | (F.col("n") > 0) & (F.col("holds") > 0)).isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): for each id with an edge (a, b), the smallest id that it reaches.

    Each turn hangs every id on the least of its neighbours, first those above it, then
    those below.  Turns are written, and end when all that is left are stars; they grow
    with the logarithm of the longest path.  One row at most comes back to the driver.
    The least neighbours are written too: both sides of the join are then plain shuffles,
    of which adaptive execution splits the rows of an id with very many edges.
    """
    def tidy(e: DataFrame) -> DataFrame:
        return e.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    now = materialise(tidy(edges), name)
    while not _are_stars(now):
        least = materialise(_neighbours(now).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), name)
        old, now = now, materialise(tidy(_small_star(tidy(_large_star(now, least)))), name)
        discard(old, least)
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
