"""Registered graph queries (G1-G3, optional tier) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import graph as G
from engram.plans.registry import register
from engram.sources import fixtures as FX

_EDGE_LOG = """
    base AS (
        SELECT 'm' || vec_id AS src, 'm' || ((vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)) AS dst,
               (['relates', 'supports', 'contradicts'])[vec_id % 3 + 1] AS type,
               CAST((vec_id * 13) % 10 AS DOUBLE) AS w, vec_id AS i FROM embeddings
        UNION ALL
        SELECT 'm' || vec_id, 'm' || ((vec_id + 1) % (SELECT count(*) FROM embeddings)), 'relates',
               CAST((vec_id * 3) % 10 AS DOUBLE), vec_id FROM embeddings WHERE vec_id % 4 = 0),
    edge_log AS (
        SELECT src, dst, type, w / 10.0::DOUBLE AS weight, 1 AS version FROM base
        UNION ALL
        SELECT src, dst, type, CAST((i * 17) % 10 AS DOUBLE) / 10.0::DOUBLE, 2 FROM base WHERE i % 5 = 0),
    edges AS (
        SELECT src, dst, type, arg_max(weight, version) AS weight, max(version) AS version
        FROM edge_log GROUP BY src, dst, type),
    seeds AS (SELECT 'm' || vec_id AS seed FROM embeddings WHERE vec_id % 25 = 7)"""


def _edges(spark, sf_dir):
    return G.connect(FX.edge_log_fx(spark, sf_dir))


def _seeds(spark, sf_dir):
    from engram.sources.tables import load_raw

    e = load_raw(spark, sf_dir, "embeddings")
    return e.filter(F.col("vec_id") % 25 == 7).select(F.concat(F.lit("m"), F.col("vec_id")).alias("seed"))


@register("graph_connect", f"WITH {_EDGE_LOG} SELECT src, dst, type, weight, version FROM edges")
def q_connect(spark, sf_dir):
    return _edges(spark, sf_dir).select("src", "dst", "type", "weight", "version")


@register("graph_related", f"""WITH {_EDGE_LOG}
    SELECT seed, rank, dst, type, weight FROM (
        SELECT s.seed, CAST(row_number() OVER (PARTITION BY s.seed ORDER BY e.weight DESC, e.dst, e.type)
               AS BIGINT) AS rank, e.dst, e.type, e.weight
        FROM seeds s JOIN edges e ON e.src = s.seed) WHERE rank <= 3""")
def q_related(spark, sf_dir):
    return G.related(_seeds(spark, sf_dir), _edges(spark, sf_dir), 3)


@register("graph_traverse", f"""WITH RECURSIVE {_EDGE_LOG},
    walk(seed, node, depth) AS (
        SELECT seed, seed, 0 FROM seeds
        UNION
        SELECT w.seed, e.dst, w.depth + 1 FROM walk w JOIN (SELECT DISTINCT src, dst FROM edges) e
          ON e.src = w.node WHERE w.depth < 3)
    SELECT seed, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY seed, node
    HAVING min(depth) > 0""")
def q_traverse(spark, sf_dir):
    return G.traverse(_seeds(spark, sf_dir), _edges(spark, sf_dir), 3)
