"""Registered ingestion queries (M1-M4, V1, W1) with DuckDB oracles."""

from __future__ import annotations


from engram.functions import scalars as S
from engram.operators import ingest as I
from engram.plans.oracle_fixtures import with_fixtures
from engram.plans.registry import register
from engram.sources import fixtures as FX

_NEAREST_CTES = {
    "arrs": "SELECT *, sqrt(list_dot_product(embedding, embedding)) AS pn FROM arrivals_fx",
    "mem": """SELECT *, sqrt(list_dot_product(embedding, embedding)) AS norm
              FROM memories_fx WHERE valid_until IS NULL""",
    "pairs": """
        SELECT a.arrival_id, m.id,
               CASE WHEN a.pn * m.norm > 0
                    THEN list_dot_product(a.embedding, m.embedding) / (a.pn * m.norm) END AS sim
        FROM arrs a JOIN mem m
          ON m.tenant_id = a.tenant_id AND m.namespace = a.namespace
         AND ((a.team_id IS NOT NULL AND m.team_id = a.team_id)
              OR (a.team_id IS NULL AND m.user_id = a.user_id))""",
    "best": """
        SELECT arrival_id, id AS nearest_id, sim AS nearest_sim FROM pairs
        QUALIFY row_number() OVER (PARTITION BY arrival_id ORDER BY sim DESC NULLS LAST, id) = 1""",
    "nearest": """
        SELECT a.arrival_id, a.arrival_order, a.tenant_id, b.nearest_id, b.nearest_sim
        FROM arrivals_fx a LEFT JOIN best b USING (arrival_id)""",
    "classified": """
        SELECT arrival_id, arrival_order, tenant_id,
               CASE WHEN nearest_sim >= 0.985::DOUBLE THEN 'duplicate'
                    WHEN nearest_sim >= 0.94::DOUBLE THEN 'replaced' ELSE 'stored' END AS action,
               nearest_id, round(nearest_sim, 4) AS similarity
        FROM nearest""",
}


@register("nearest_one", with_fixtures("""
    SELECT arrival_id, arrival_order, nearest_id, round(nearest_sim, 4) AS similarity FROM nearest""",
    "memories_fx", "arrivals_fx", extra=_NEAREST_CTES))
def q_nearest_one(spark, sf_dir):
    n = I.nearest_one(FX.arrivals_fx(spark, sf_dir), FX.memories_fx(spark, sf_dir))
    return n.select("arrival_id", "arrival_order", "nearest_id",
                    S.round4("nearest_sim").alias("similarity"))


_CLASSIFY_BODY = """
    SELECT arrival_id, action,
           CASE WHEN action = 'duplicate' THEN nearest_id ELSE arrival_id END AS memory_id,
           CASE WHEN action = 'replaced' THEN nearest_id END AS replaced_id,
           similarity
    FROM classified"""


@register("classify_facts", with_fixtures(_CLASSIFY_BODY, "memories_fx", "arrivals_fx",
                                          extra=_NEAREST_CTES))
def q_classify(spark, sf_dir):
    return I.classify(FX.arrivals_fx(spark, sf_dir), FX.memories_fx(spark, sf_dir))


_NEAR_PAIRS_CTES = {
    "mem": _NEAREST_CTES["mem"],
    "a": "SELECT *, sqrt(list_dot_product(embedding, embedding)) AS pn FROM arrivals_chain_fx",
    "e1": """
        SELECT a.arrival_id AS src, m.id AS dst, 'memory' AS dst_kind,
               CASE WHEN a.pn * m.norm > 0
                    THEN list_dot_product(a.embedding, m.embedding) / (a.pn * m.norm) END AS sim
        FROM a JOIN mem m ON m.tenant_id = a.tenant_id AND m.namespace = a.namespace
         AND ((a.team_id IS NOT NULL AND m.team_id = a.team_id)
              OR (a.team_id IS NULL AND m.user_id = a.user_id))""",
    "e2": """
        SELECT a.arrival_id AS src, b.arrival_id AS dst, 'arrival' AS dst_kind,
               CASE WHEN a.pn * b.pn > 0
                    THEN list_dot_product(a.embedding, b.embedding) / (a.pn * b.pn) END AS sim
        FROM a JOIN a b ON b.tenant_id = a.tenant_id AND b.namespace = a.namespace
         AND b.arrival_order < a.arrival_order
         AND ((a.team_id IS NOT NULL AND b.team_id = a.team_id)
              OR (a.team_id IS NULL AND b.user_id = a.user_id))""",
}
_NEAR_PAIRS_BODY = """
    SELECT src, dst, dst_kind, round(sim, 4) AS similarity
    FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2) WHERE sim >= 0.94::DOUBLE"""


@register("near_pairs", with_fixtures(_NEAR_PAIRS_BODY, "memories_fx", "arrivals_chain_fx",
                                      extra=_NEAR_PAIRS_CTES))
def q_near_pairs(spark, sf_dir):
    e = I.near_pairs(FX.arrivals_fx(spark, sf_dir, chained=True), FX.memories_fx(spark, sf_dir))
    return e.select("src", "dst", "dst_kind", S.round4("sim").alias("similarity"))


# the batch walked one arrival at a time: gone are replaced rows and duplicates
_STORE_CTES = _NEAR_PAIRS_CTES | {
    "ready": "SELECT *, row_number() OVER (ORDER BY arrival_order, arrival_id) AS k FROM arrivals_chain_fx",
    "edges": """
        SELECT r.k, e.dst, e.sim FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2) e JOIN ready r ON r.arrival_id = e.src
        WHERE e.sim >= 0.94::DOUBLE""",
    "walk": """
        SELECT 0::BIGINT AS k, []::VARCHAR[] AS gone, NULL::VARCHAR AS action, NULL::VARCHAR AS target, NULL::DOUBLE AS sim
        UNION ALL
        SELECT k, CASE action WHEN 'duplicate' THEN list_append(gone, arrival_id) WHEN 'replaced' THEN list_append(gone, best.d)
                              ELSE gone END, action, best.d, -best.s
        FROM (SELECT *, CASE WHEN best IS NULL THEN 'stored' WHEN -best.s >= 0.985::DOUBLE THEN 'duplicate' ELSE 'replaced' END AS action
              FROM (SELECT r.k, any_value(r.arrival_id) AS arrival_id, any_value(w.gone) AS gone,
                           min({'s': -e.sim, 'd': e.dst}) FILTER (WHERE e.dst IS NOT NULL) AS best
                    FROM walk w JOIN ready r ON r.k = w.k + 1
                    LEFT JOIN edges e ON e.k = r.k AND NOT list_contains(w.gone, e.dst)
                    GROUP BY r.k))""",
}


@register("store_batch", with_fixtures("""
    SELECT r.arrival_id, r.arrival_order, r.tenant_id, w.action,
           CASE WHEN w.action = 'duplicate' THEN w.target ELSE r.arrival_id END AS memory_id,
           CASE WHEN w.action = 'replaced' THEN w.target END AS replaced_id, round(w.sim, 4) AS similarity
    FROM walk w JOIN ready r USING (k)""", "memories_fx", "arrivals_chain_fx", extra=_STORE_CTES).replace("WITH ", "WITH RECURSIVE ", 1))
def q_store_batch(spark, sf_dir):
    """M2 over the chained arrivals; the oracle walks them one by one."""
    return I.store(FX.arrivals_fx(spark, sf_dir, chained=True), FX.memories_fx(spark, sf_dir))


_QUOTA_BODY = """
    SELECT arrival_id, arrival_order, tenant_id,
           CASE WHEN cb >= lim THEN 402 WHEN action = 'duplicate' THEN 200 ELSE 201 END AS status,
           CASE WHEN cb >= lim THEN 'refused' ELSE action END AS action,
           CASE WHEN cb < lim THEN memory_id END AS memory_id,
           CASE WHEN cb < lim THEN replaced_id END AS replaced_id,
           CAST(cb AS BIGINT) AS count_before
    FROM (
        SELECT c.*, coalesce(u.used, 0) + coalesce(sum(CASE WHEN c.action = 'stored' THEN 1 ELSE 0 END)
                   OVER (PARTITION BY c.tenant_id ORDER BY c.arrival_order, c.arrival_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
               coalesce(t.memory_limit, 10000) AS lim
        FROM (SELECT arrival_id, arrival_order, tenant_id, action,
                     CASE WHEN action = 'duplicate' THEN nearest_id ELSE arrival_id END AS memory_id,
                     CASE WHEN action = 'replaced' THEN nearest_id END AS replaced_id
              FROM classified) c
        LEFT JOIN (SELECT tenant_id, count(*) AS used FROM memories_fx
                   WHERE valid_until IS NULL GROUP BY tenant_id) u USING (tenant_id)
        LEFT JOIN tenants_fx t ON t.id = c.tenant_id
    )"""


@register("quota_gate", with_fixtures(_QUOTA_BODY, "memories_fx", "arrivals_fx", "tenants_fx",
                                      extra=_NEAREST_CTES))
def q_quota_gate(spark, sf_dir):
    """M3 on the chainless batch (where M2 = M1), against tenants_fx."""
    arrivals, mem = FX.arrivals_fx(spark, sf_dir), FX.memories_fx(spark, sf_dir)
    c = I.classify(arrivals, mem).join(arrivals.select("arrival_id", "arrival_order", "tenant_id"),
                                       "arrival_id")
    return I.quota_gate(c, I.active_counts(mem), FX.tenants_fx(spark, sf_dir))


@register("store_access", with_fixtures("""
    SELECT a.arrival_id, a.team_id,
           CASE WHEN a.team_id IS NULL THEN 200 WHEN x.role IS NULL THEN 403
                WHEN x.role = 'read_only' THEN 403 ELSE 200 END AS status,
           CASE WHEN a.team_id IS NULL THEN NULL WHEN x.role IS NULL THEN 'not a member'
                WHEN x.role = 'read_only' THEN 'read only' END AS reason
    FROM arrivals_chain_fx a LEFT JOIN team_access_fx x
      ON x.team_id = a.team_id AND x.user_id = a.user_id AND x.tenant_id = a.tenant_id""",
    "arrivals_chain_fx", "team_access_fx"))
def q_store_access(spark, sf_dir):
    a = FX.arrivals_fx(spark, sf_dir, chained=True)
    out = I.store_access(a, FX.team_members_fx(spark, sf_dir), FX.teams_fx(spark, sf_dir))
    return out.select("arrival_id", "team_id", "status", "reason")
