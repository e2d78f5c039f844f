"""The composed store path: outcomes and the next snapshot, with oracles that
walk the requests one by one in a recursive CTE."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from engram.operators import store_path as P
from engram.plans.oracle_fixtures import AS_OF_SQL, with_fixtures
from engram.plans.registry import register
from engram.session import ensure_checkpoint_dir
from engram.sources import fixtures as FX
from engram.sources.tables import load_table, write_snapshot

TEAM_PATTERN = "^team[0-9]+$"  # the fixture's team ids

_IN_SCOPE = """{b}.tenant_id = a.tenant_id AND {b}.namespace = a.namespace
         AND ((a.team_id IS NOT NULL AND {b}.team_id = a.team_id) OR (a.team_id IS NULL AND {b}.user_id = a.user_id))"""
_SIM = "list_dot_product(a.embedding, {b}.embedding) / (a.pn * {b}.pn)"

STORE_WALK = {
    "checked": """
        SELECT r.arrival_id, r.arrival_order, r.via, r.tenant_id, r.user_id,
               coalesce(r.namespace, 'default') AS namespace,
               CASE WHEN r.via <> 'tool' THEN r.team_id END AS team_id,
               CASE WHEN r.via <> 'tool' THEN r.visibility END AS visibility,
               r.fact, r.embedding, sqrt(list_dot_product(r.embedding, r.embedding)) AS pn,
               coalesce(r.importance, 0.5::DOUBLE) AS importance,
               coalesce(r.source, CASE r.via WHEN 'tool' THEN 'openai' ELSE 'api' END) AS source,
               CASE WHEN coalesce(length(r.user_id), 0) < 1 OR coalesce(length(r.fact), 0) < 1 THEN 400
                    WHEN r.via = 'tool' THEN 200
                    WHEN length(r.fact) > 2000 OR coalesce(r.importance NOT BETWEEN 0 AND 1, false)
                      OR coalesce(length(r.source) > 50, false) OR coalesce(length(r.namespace) > 100, false)
                      OR coalesce(r.visibility NOT IN ('private', 'team'), false) THEN 400
                    WHEN r.team_id IS NOT NULL AND (x.role IS NULL OR x.role = 'read_only') THEN 403
                    ELSE 200 END AS status
        FROM store_requests_fx r LEFT JOIN team_access_fx x
          ON x.team_id = r.team_id AND x.user_id = r.user_id AND x.tenant_id = r.tenant_id""",
    "ready": """
        SELECT *, row_number() OVER (ORDER BY arrival_order, arrival_id) AS k FROM checked WHERE status = 200""",
    "mem": """
        SELECT *, sqrt(list_dot_product(embedding, embedding)) AS pn FROM memories_fx WHERE valid_until IS NULL""",
    "edges": f"""
        SELECT * FROM (
            SELECT a.k, b.id AS dst, {_SIM.format(b='b')} AS sim
            FROM ready a JOIN mem b ON {_IN_SCOPE.format(b='b')}
            UNION ALL
            SELECT a.k, b.arrival_id, {_SIM.format(b='b')}
            FROM ready a JOIN ready b ON b.k < a.k AND {_IN_SCOPE.format(b='b')})
        WHERE sim >= 0.94::DOUBLE""",
    "walk": """
        SELECT 0::BIGINT AS k, []::VARCHAR[] AS gone,
               (SELECT map_from_entries(list({'k': tenant_id, 'v': used}))
                FROM (SELECT tenant_id, count(*) AS used FROM mem GROUP BY tenant_id)) AS counts,
               NULL::VARCHAR AS action, NULL::VARCHAR AS target, NULL::DOUBLE AS sim, NULL::BIGINT AS before
        UNION ALL
        SELECT k,
               CASE WHEN action IN ('duplicate', 'refused') THEN list_append(gone, arrival_id)
                    WHEN action = 'replaced' THEN list_append(gone, best.d) ELSE gone END,
               CASE WHEN action = 'stored' THEN map_concat(counts, map([tenant_id], [before + 1])) ELSE counts END,
               action, CASE WHEN action IN ('duplicate', 'replaced') THEN best.d END,
               CASE WHEN action IN ('duplicate', 'replaced') THEN -best.s END, before
        FROM (SELECT *, CASE WHEN via <> 'tool' AND before >= lim THEN 'refused'
                             WHEN best IS NULL THEN 'stored' WHEN -best.s >= 0.985::DOUBLE THEN 'duplicate'
                             ELSE 'replaced' END AS action
              FROM (SELECT r.k, any_value(r.arrival_id) AS arrival_id, any_value(r.tenant_id) AS tenant_id,
                           any_value(r.via) AS via, any_value(w.gone) AS gone, any_value(w.counts) AS counts,
                           any_value(coalesce(w.counts[r.tenant_id], 0)) AS before,
                           any_value(coalesce(t.memory_limit, 10000)) AS lim,
                           min({'s': -e.sim, 'd': e.dst}) FILTER (WHERE e.dst IS NOT NULL) AS best
                    FROM walk w JOIN ready r ON r.k = w.k + 1 LEFT JOIN store_tenants_fx t ON t.id = r.tenant_id
                    LEFT JOIN edges e ON e.k = r.k AND NOT list_contains(w.gone, e.dst)
                    GROUP BY r.k))""",
    "done": """
        SELECT r.*, w.action, w.target, round(w.sim, 4) AS similarity, w.before
        FROM walk w JOIN ready r USING (k)""",
}
_FIXTURES = ("store_requests_fx", "store_tenants_fx", "memories_fx", "team_access_fx")


def recursive(body: str, *names: str, extra: dict[str, str]) -> str:
    return with_fixtures(body, *names, extra=extra).replace("WITH ", "WITH RECURSIVE ", 1)


def _outcomes(spark, sf_dir):
    return P.store_requests(
        FX.store_requests_fx(spark, sf_dir), FX.memories_fx(spark, sf_dir), FX.store_tenants_fx(spark, sf_dir),
        FX.team_members_fx(spark, sf_dir), FX.teams_fx(spark, sf_dir), TEAM_PATTERN)


@register("store_pipeline", recursive("""
    SELECT arrival_id, arrival_order, tenant_id,
           CASE WHEN action = 'refused' THEN 402 WHEN via <> 'tool' AND action = 'duplicate' THEN 200 ELSE 201 END AS status,
           action,
           CASE action WHEN 'duplicate' THEN target WHEN 'refused' THEN NULL ELSE arrival_id END AS memory_id,
           CASE WHEN action = 'replaced' THEN target END AS replaced_id, similarity, before AS count_before
    FROM done
    UNION ALL
    SELECT arrival_id, arrival_order, tenant_id, status, 'rejected', NULL, NULL, NULL, NULL
    FROM checked WHERE status <> 200""", *_FIXTURES, extra=STORE_WALK))
def q_store_pipeline(spark, sf_dir):
    """Validate, team gate, quota and dedup of a whole batch in arrival order."""
    return _outcomes(spark, sf_dir)[0].select(
        "arrival_id", "arrival_order", "tenant_id", "status", "action", "memory_id", "replaced_id", "similarity", "count_before")


@register("store_snapshot", recursive(f"""
    SELECT id, tenant_id, user_id, namespace, team_id, visibility, importance, source,
           strftime(CASE WHEN valid_until IS NULL AND id IN (SELECT target FROM done WHERE action = 'replaced')
                         THEN {AS_OF_SQL} ELSE valid_until END, '%Y-%m-%d %H:%M:%S') AS valid_until
    FROM (SELECT id, tenant_id, user_id, namespace, team_id, visibility, importance, source, valid_until FROM memories_fx
          UNION ALL
          SELECT arrival_id, tenant_id, user_id, namespace, team_id,
                 CASE WHEN team_id IS NOT NULL THEN 'team' ELSE coalesce(visibility, 'private') END,
                 importance, source, NULL
          FROM done WHERE action IN ('stored', 'replaced'))""", *_FIXTURES, extra=STORE_WALK))
def q_store_snapshot(spark, sf_dir):
    """The snapshot after the batch, written over the one before by the
    tenants that changed, and read again."""
    memories = FX.memories_fx(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    write_snapshot(memories, path)
    outcomes, accepted = _outcomes(spark, sf_dir)
    new = P.next_snapshot(memories, accepted, outcomes, FX.as_of_col())
    P.write_touched(memories, new, outcomes, path)
    return load_table(spark, path, "memories").select(
        "id", "tenant_id", "user_id", "namespace", "team_id", "visibility", "importance", "source",
        F.date_format("valid_until", "yyyy-MM-dd HH:mm:ss").alias("valid_until"))


__all__ = ["recursive", "STORE_WALK"]
