"""Connected components in logarithmic rounds (alternating large and small stars)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of the node and its neighbours: the
    neighbours above it (large star), or itself and those below it (small star)."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    near = both.join(least.withColumn("m", F.least("a", "m")), "a")
    if large:
        out = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def star_round(edges: DataFrame) -> DataFrame:
    """One large and one small star over ``edges`` (a, b): the same components, with
    shorter paths and a > b in every row."""
    return _stars(_stars(edges, large=True), large=False)


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has exactly one, by one count per node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    per = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return per.filter("out + into > 1 and out > 0").isEmpty()


def connected_components(edges: DataFrame, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    ``store`` cuts the lineage of a round reliably.  The number of rounds grows with
    the logarithm of the longest path, so there is no cap on it: the rounds end when
    only stars around their least node are left.  A star's centre may have any number
    of neighbours: the minima are pre-aggregated per task and the join back can be split."""
    edges = edges.filter(F.col("a") != F.col("b"))
    edges = store(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_forest_of_stars(edges):
        edges = store(star_round(edges))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
