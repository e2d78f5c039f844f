"""Documented-only memory graph (G1-G3; the service describes it but ships
no table, so these semantics are ours): typed, weighted edges between
memories, one-hop neighbours, and bounded breadth-first traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.session import ensure_checkpoint_dir


def connect(edge_log: DataFrame) -> DataFrame:
    """G1: upsert -- the latest version of each (src, dst, type) wins."""
    return (edge_log.groupBy("src", "dst", "type")
            .agg(F.max_by("weight", "version").alias("weight"), F.max("version").alias("version")))


def related(seeds: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Each seed's out-neighbours, weight desc (dst breaks ties), top k
    (a literal bound, planned as WindowGroupLimit)."""
    j = seeds.select("seed").join(edges.withColumnRenamed("src", "seed"), "seed")
    w = Window.partitionBy("seed").orderBy(F.col("weight").desc(), F.col("dst"), F.col("type"))
    return (j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("seed", F.col("rank").cast("bigint"), "dst", "type", "weight"))


def traverse(seeds: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """Nodes reachable from each seed within ``max_depth`` hops, each at
    its least depth.  One join per level against the edge list; nodes seen
    before are removed with an anti join; each level is checkpointed."""
    ensure_checkpoint_dir(seeds.sparkSession)
    e = edges.select("src", "dst").distinct()
    visited = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).checkpoint()
    frontier = visited
    for d in range(1, max_depth + 1):
        nxt = (frontier.join(e, frontier["node"] == e["src"])
               .select("seed", F.col("dst").alias("node")).distinct()
               .join(visited.select("seed", "node"), ["seed", "node"], "left_anti")
               .withColumn("depth", F.lit(d))).checkpoint()
        if nxt.limit(1).count() == 0:
            break
        visited = visited.unionByName(nxt).checkpoint()
        frontier = nxt
    return visited.filter(F.col("depth") > 0).select("seed", "node", F.col("depth").cast("bigint"))
