"""Tool calls carried out in call order: one result table per kind, with
oracles that walk the stores and deletes one by one in a recursive CTE."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators.tool_exec import ToolRun
from engram.plans.memory_queries import DECAY_SQL, ISO_SQL
from engram.plans.oracle_fixtures import AS_OF_SQL
from engram.plans.registry import register
from engram.plans.store_queries import recursive
from engram.sources import fixtures as FX

_SCOPE = "b.tenant_id = a.tenant_id AND b.namespace = a.namespace AND b.user_id = a.user_id"
_SIM = "list_dot_product(a.vector, b.{v}) / (a.pn * b.pn)"

_WALK = {
    "stores": """
        SELECT 'c' || call_id AS id, call_id, tenant_id, user_id, coalesce(namespace, 'default') AS namespace, fact, vector,
               sqrt(list_dot_product(vector, vector)) AS pn, coalesce(importance, 0.5::DOUBLE) AS importance,
               coalesce(source, 'openai') AS source
        FROM tool_log_fx WHERE kind = 0 AND user_id IS NOT NULL""",
    "deletes": """
        SELECT call_id, tenant_id, memory_id FROM tool_log_fx WHERE kind = 3 AND memory_id IS NOT NULL""",
    "mem": """
        SELECT *, sqrt(list_dot_product(embedding, embedding)) AS pn FROM memories_fx WHERE valid_until IS NULL""",
    "edges": f"""
        SELECT * FROM (
            SELECT a.call_id, b.id AS dst, {_SIM.format(v='embedding')} AS sim FROM stores a JOIN mem b ON {_SCOPE}
            UNION ALL
            SELECT a.call_id, b.id, {_SIM.format(v='vector')} FROM stores a JOIN stores b ON b.call_id < a.call_id AND {_SCOPE})
        WHERE sim >= 0.94::DOUBLE""",
    "steps": """
        SELECT *, row_number() OVER (ORDER BY call_id) AS k FROM (
            SELECT call_id, id, NULL AS target FROM stores WHERE call_id IN (SELECT call_id FROM edges)
            UNION ALL
            SELECT d.call_id, NULL, d.memory_id
            FROM deletes d JOIN (SELECT id, tenant_id, -1 AS born FROM mem UNION ALL SELECT id, tenant_id, call_id FROM stores) t
              ON t.id = d.memory_id AND t.tenant_id = d.tenant_id AND t.born < d.call_id)""",
    "walk": """
        SELECT 0::BIGINT AS k, []::VARCHAR[] AS gone, NULL::BIGINT AS call_id, NULL::VARCHAR AS action, NULL::VARCHAR AS target,
               NULL::DOUBLE AS sim
        UNION ALL
        SELECT k, CASE action WHEN 'duplicate' THEN list_append(gone, id) WHEN 'replaced' THEN list_append(gone, best.d)
                              WHEN 'deleted' THEN list_append(gone, wanted) ELSE gone END,
               call_id, action, coalesce(wanted, CASE WHEN action IN ('duplicate', 'replaced') THEN best.d END), -best.s
        FROM (SELECT *, CASE WHEN wanted IS NOT NULL THEN CASE WHEN list_contains(gone, wanted) THEN 'missing' ELSE 'deleted' END
                             WHEN best IS NULL THEN 'stored' WHEN -best.s >= 0.985::DOUBLE THEN 'duplicate'
                             ELSE 'replaced' END AS action
              FROM (SELECT v.k, any_value(v.call_id) AS call_id, any_value(v.id) AS id, any_value(v.target) AS wanted,
                           any_value(w.gone) AS gone, min({'s': -e.sim, 'd': e.dst}) FILTER (WHERE e.dst IS NOT NULL) AS best
                    FROM walk w JOIN steps v ON v.k = w.k + 1
                    LEFT JOIN edges e ON e.call_id = v.call_id AND NOT list_contains(w.gone, e.dst)
                    GROUP BY v.k))""",
    "done": "SELECT call_id, action, target, sim FROM walk WHERE call_id IS NOT NULL",
    "kept": """
        SELECT s.*, coalesce(w.action, 'stored') AS action, w.target, w.sim FROM stores s LEFT JOIN done w USING (call_id)""",
    "lives": f"""
        SELECT r.*, d.call_id AS died FROM (
            SELECT id, tenant_id, user_id, namespace, fact, embedding, pn, importance, source, created_at, -1 AS born FROM mem
            UNION ALL
            SELECT id, tenant_id, user_id, namespace, fact, vector, pn, importance, source, {AS_OF_SQL}, call_id
            FROM kept WHERE action <> 'duplicate') r
        LEFT JOIN (SELECT target, call_id FROM done WHERE action IN ('replaced', 'deleted')) d ON d.target = r.id""",
}
_ALIVE = "m.born < a.call_id AND (m.died IS NULL OR m.died > a.call_id)"
_READ = "m.tenant_id = a.tenant_id AND m.user_id = a.user_id AND m.namespace = a.ns"
_SCORED = f"""
    SELECT call_id AS query_id, lim, cand_rank, id, fact, importance, round({DECAY_SQL}, 4) AS decay_score, round(sim, 4) AS similarity,
           round(sim * 0.7::DOUBLE + {DECAY_SQL} * 0.3::DOUBLE, 4) AS score, source, namespace, created_at FROM cands"""


def _reads(calls: str, source: bool) -> dict[str, str]:
    return {
        "asked": calls,
        "cands": f"""
            SELECT a.call_id, a.lim, m.id, m.fact, m.importance, m.source, m.namespace, m.created_at,
                   list_dot_product(a.vector, m.embedding) / (a.pn * m.pn) AS sim,
                   row_number() OVER (PARTITION BY a.call_id ORDER BY list_dot_product(a.vector, m.embedding) / (a.pn * m.pn) DESC, m.id)
                       AS cand_rank
            FROM asked a JOIN lives m ON {_READ} AND {_ALIVE} {"AND m.source = a.src" if source else ""}
            WHERE a.vector IS NOT NULL QUALIFY cand_rank <= 2 * lim""",
        "scored": _SCORED,
    }


_SEARCH = _WALK | _reads("""
    SELECT call_id, tenant_id, user_id, coalesce(source, 'default') AS ns, coalesce(namespace, 'default') AS src,
           least(coalesce(lim, 10), 50) AS lim, vector, sqrt(list_dot_product(vector, vector)) AS pn
    FROM tool_log_fx WHERE kind = 1 AND user_id IS NOT NULL""", source=True) | {
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_rank) AS rnk FROM scored"}
_CONTEXT = _WALK | _reads("""
    SELECT call_id, tenant_id, user_id, coalesce(namespace, 'default') AS ns, least(coalesce(top_n, 5), 20) AS lim,
           CASE WHEN q IS NOT NULL THEN vector END AS vector, sqrt(list_dot_product(vector, vector)) AS pn
    FROM tool_log_fx WHERE kind = 2 AND user_id IS NOT NULL""", source=False) | {
    "recent": f"""
        SELECT call_id AS query_id, lim, cand_rank, id, fact, importance, round({DECAY_SQL}, 4) AS decay_score,
               round({DECAY_SQL}, 4) AS score, source
        FROM (SELECT a.call_id, a.lim, m.*, row_number() OVER (PARTITION BY a.call_id ORDER BY m.created_at DESC, m.id) AS cand_rank
              FROM asked a JOIN lives m ON {_READ} AND {_ALIVE} WHERE a.vector IS NULL QUALIFY cand_rank <= 2 * lim)""",
    "res": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_rank) AS rnk FROM (
            SELECT query_id, lim, cand_rank, id, fact, importance, decay_score, score, source FROM scored
            UNION ALL SELECT * FROM recent) QUALIFY rnk <= lim""",
    "lines": """
        SELECT query_id, count(*) AS n,
               string_agg('[' || rnk || '] (importance: ' || regexp_replace(CAST(importance AS VARCHAR), '\\.0$', '') || ', decay: '
                          || CASE WHEN regexp_replace(printf('%.4f', decay_score), '\\.?0+$', '') = '' THEN '0'
                                  ELSE regexp_replace(printf('%.4f', decay_score), '\\.?0+$', '') END
                          || ', source: ' || source || ') ' || fact, chr(10) ORDER BY rnk) AS context
        FROM res GROUP BY query_id""",
}


def _run(spark, sf_dir) -> ToolRun:
    return ToolRun(FX.tool_log_fx(spark, sf_dir), FX.memories_fx(spark, sf_dir), FX.as_of_col(), FX.TOOL_PREFIX)


@register("tool_store", recursive("""
    SELECT call_id, action, CASE WHEN action = 'duplicate' THEN target ELSE id END AS memory_id,
           CASE WHEN action = 'replaced' THEN target END AS replaced_id,
           CASE WHEN action <> 'stored' THEN round(sim, 4) END AS similarity FROM kept""",
    "tool_log_fx", "memories_fx", extra=_WALK))
def q_tool_store(spark, sf_dir):
    """Stores of a tool-call log, with the deletes between them carried out."""
    return _run(spark, sf_dir).stored()


@register("tool_delete", recursive("""
    SELECT d.call_id, d.memory_id, CASE WHEN w.action = 'deleted' THEN 204 ELSE 404 END AS status
    FROM deletes d LEFT JOIN done w USING (call_id)""", "tool_log_fx", "memories_fx", extra=_WALK))
def q_tool_delete(spark, sf_dir):
    """Deletes of a tool-call log, also of memories that the log has stored."""
    return _run(spark, sf_dir).delete_results()


@register("tool_search", recursive(f"""
    SELECT query_id, CAST(rnk AS BIGINT) AS rank, id, fact, importance, decay_score, similarity, score, source, namespace,
           {ISO_SQL.format(c='created_at')} AS created_at FROM ranked WHERE rnk <= lim""", "tool_log_fx", "memories_fx", extra=_SEARCH))
def q_tool_search(spark, sf_dir):
    """Search calls, each over the memories that live at its place in the log."""
    return _run(spark, sf_dir).search_results()


@register("tool_context", recursive("""
    SELECT a.call_id AS query_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_memories,
           coalesce(l.context, 'No relevant memories found.') AS context
    FROM asked a LEFT JOIN lines l ON l.query_id = a.call_id""", "tool_log_fx", "memories_fx", extra=_CONTEXT))
def q_tool_context(spark, sf_dir):
    """Context calls, with and without a query, at their place in the log."""
    return _run(spark, sf_dir).context_results()


@register("tool_usage", recursive("""
    SELECT call_id, plan, memory_limit, used AS memories_used, memory_limit - used AS memories_remaining FROM (
        SELECT l.call_id, l.asked, coalesce(t.plan, 'free') AS plan, CAST(coalesce(t.memory_limit, 10000) AS BIGINT) AS memory_limit,
               CAST(coalesce(m.used, 0) + sum(l.change) OVER (PARTITION BY l.tenant_id ORDER BY l.call_id) AS BIGINT) AS used
        FROM (SELECT call_id, tenant_id, 0 AS change, true AS asked FROM tool_log_fx WHERE kind = 4
              UNION ALL SELECT call_id, tenant_id, 1, false FROM kept WHERE action = 'stored'
              UNION ALL SELECT d.call_id, d.tenant_id, -1, false FROM deletes d JOIN done w USING (call_id) WHERE w.action = 'deleted') l
        LEFT JOIN (SELECT tenant_id, count(*) AS used FROM mem GROUP BY tenant_id) m USING (tenant_id)
        LEFT JOIN tenants_fx t ON t.id = l.tenant_id) WHERE asked""", "tool_log_fx", "memories_fx", "tenants_fx", extra=_WALK))
def q_tool_usage(spark, sf_dir):
    """Usage calls: active memories of the tenant at their place in the log."""
    return _run(spark, sf_dir).usage_results(FX.tenants_fx(spark, sf_dir))


@register("tool_snapshot", recursive(f"""
    SELECT m.id, m.tenant_id, m.source, strftime(coalesce(m.valid_until, CASE WHEN l.died IS NOT NULL THEN {AS_OF_SQL} END),
           '%Y-%m-%d %H:%M:%S') AS valid_until
    FROM (SELECT id, tenant_id, source, valid_until FROM memories_fx
          UNION ALL SELECT id, tenant_id, source, NULL FROM kept WHERE action <> 'duplicate') m
    LEFT JOIN lives l USING (id)""", "tool_log_fx", "memories_fx", extra=_WALK))
def q_tool_snapshot(spark, sf_dir):
    """The memories after the log."""
    return _run(spark, sf_dir).snapshot().select("id", "tenant_id", "source", F.date_format("valid_until", "yyyy-MM-dd HH:mm:ss").alias("valid_until"))
