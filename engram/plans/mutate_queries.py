"""Registered mutation queries (M5, M6, M7, T1, S3) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import scalars as S
from engram.operators import mutate as M
from engram.operators import retrieval as R
from engram.plans.memory_queries import _search_sql
from engram.plans.oracle_fixtures import with_fixtures
from engram.plans.registry import register
from engram.sources import fixtures as FX


@register("soft_delete", with_fixtures("""
    SELECT cmd_id, memory_id,
           CASE WHEN hit AND coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (
                    PARTITION BY memory_id ORDER BY cmd_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 204 ELSE 404 END AS status
    FROM (SELECT c.cmd_id, c.memory_id, coalesce(m.tenant_id = c.tenant_id, false) AS hit
          FROM memory_cmds_fx c LEFT JOIN memories_fx m ON m.id = c.memory_id AND m.valid_until IS NULL)""",
    "memory_cmds_fx", "memories_fx"))
def q_soft_delete(spark, sf_dir):
    return M.soft_delete(FX.memory_cmds_fx(spark, sf_dir).select("cmd_id", "tenant_id", "memory_id"),
                         FX.memories_fx(spark, sf_dir))


@register("patch_memories", with_fixtures("""
    SELECT cmd_id, memory_id, status,
           CASE WHEN status = 200 THEN coalesce(last_value(CASE WHEN status = 200 THEN visibility END IGNORE NULLS)
                OVER w, vis0) END AS visibility,
           CASE WHEN status = 200 THEN coalesce(last_value(CASE WHEN status = 200 THEN importance END IGNORE NULLS)
                OVER w, imp0) END AS importance,
           CASE WHEN status = 200 AND max(CASE WHEN status = 200 AND visibility = 'private' THEN 1 ELSE 0 END)
                OVER w = 0 THEN team0 END AS team_id
    FROM (
        SELECT c.*, m.visibility AS vis0, m.importance AS imp0, m.team_id AS team0,
               CASE WHEN (c.visibility IS NOT NULL AND c.visibility NOT IN ('private', 'team'))
                      OR (c.importance IS NOT NULL AND (c.importance < 0 OR c.importance > 1))
                      OR (c.visibility IS NULL AND c.importance IS NULL) THEN 400
                    WHEN m.id IS NULL OR m.tenant_id <> c.tenant_id THEN 404 ELSE 200 END AS status
        FROM memory_cmds_fx c LEFT JOIN memories_fx m ON m.id = c.memory_id AND m.valid_until IS NULL)
    WINDOW w AS (PARTITION BY memory_id ORDER BY cmd_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "memory_cmds_fx", "memories_fx"))
def q_patch(spark, sf_dir):
    return M.patch(FX.memory_cmds_fx(spark, sf_dir), FX.memories_fx(spark, sf_dir))


_TOUCH_BODY = """
    SELECT r.id, CAST(m.access_count + count(*) AS BIGINT) AS access_count,
           round(arg_max(r.raw_sim, r.query_id), 4) AS decay_score,
           strftime(TIMESTAMP '2024-01-31 00:00:00', '%Y-%m-%d %H:%M:%S') AS last_accessed_at
    FROM (SELECT query_id, id, raw_sim FROM ranked WHERE rnk <= lim) r JOIN memories_fx m ON m.id = r.id
    GROUP BY r.id, m.access_count"""


def _touch_sql() -> str:
    # the search oracle's CTEs, with the unrounded similarity carried along
    base = _search_sql("queries_fx")
    head, _, _ = base.rpartition("\n    SELECT query_id, CAST(rnk AS BIGINT)")
    head = head.replace("round(sim, 4) AS similarity,", "round(sim, 4) AS similarity, sim AS raw_sim,")
    return head + _TOUCH_BODY


@register("touch_memories", _touch_sql())
def q_touch(spark, sf_dir):
    mem = FX.memories_fx(spark, sf_dir)
    res = R.search(FX.queries_fx(spark, sf_dir), mem, FX.as_of_col(), FX.team_members_fx(spark, sf_dir),
                   FX.teams_fx(spark, sf_dir), keep_raw=True)
    t = M.touch(res, mem, FX.as_of_col())
    return t.select("id", "access_count", S.round4("decay_score").alias("decay_score"),
                    F.date_format("last_accessed_at", "yyyy-MM-dd HH:mm:ss").alias("last_accessed_at"))


_TOOL_SQL = """
    SELECT call_id, tenant_id, name, kind, status,
           CASE WHEN status = 400 THEN CASE WHEN NOT known THEN 'unknown function'
                                             ELSE 'missing required argument' END
                WHEN status = 404 THEN 'memory not found' END AS reason,
           user_id, memory_id,
           CASE WHEN status < 400 THEN CASE WHEN kind = 'search_memories' THEN coalesce(source, 'default')
                                            ELSE coalesce(namespace, 'default') END END AS namespace,
           CASE WHEN status < 400 THEN CASE WHEN kind = 'store_memory' THEN coalesce(source, 'openai')
                                            WHEN kind = 'search_memories' THEN coalesce(namespace, 'default')
                                            ELSE source END END AS source,
           CASE WHEN status < 400 THEN CASE WHEN kind = 'search_memories' THEN least(coalesce(lim, 10), 50)
                                            WHEN kind = 'get_context' THEN least(coalesce(top_n, 5), 20) END
                END::BIGINT AS "limit",
           CASE WHEN status < 400 AND kind = 'store_memory' THEN coalesce(importance, 0.5) END AS importance
    FROM (
      SELECT * REPLACE (CASE WHEN kind <> 'delete_memory' OR status <> 200 OR kind IS NULL THEN status
                             WHEN hit AND row_number() OVER (PARTITION BY hit, status, kind, memory_id ORDER BY call_id) = 1 THEN 204
                             ELSE 404 END AS status)
      FROM (
        SELECT c.*, EXISTS (SELECT 1 FROM memories_fx m WHERE m.id = c.memory_id AND m.tenant_id = c.tenant_id
                            AND m.valid_until IS NULL) AS hit
        FROM (
        SELECT *, CASE WHEN NOT known THEN 400
                       WHEN kind = 'store_memory' AND (coalesce(user_id, '') = '' OR coalesce(fact, '') = '') THEN 400
                       WHEN kind = 'search_memories' AND (coalesce(user_id, '') = '' OR coalesce(q, '') = '') THEN 400
                       WHEN kind = 'get_context' AND coalesce(user_id, '') = '' THEN 400
                       WHEN kind = 'delete_memory' AND coalesce(memory_id, '') = '' THEN 400
                       WHEN kind = 'store_memory' THEN 201 ELSE 200 END AS status
        FROM (
            SELECT *, coalesce(kind IN ('store_memory', 'search_memories', 'get_context', 'delete_memory',
                                        'get_usage'), false) AS known
            FROM (
                SELECT e.event_id AS call_id, 't' || (e.user_id % 3) AS tenant_id,
                       (['mem_store_memory', 'mem_search_memories', 'mem_get_context', 'mem_delete_memory',
                         'mem_get_usage', 'other_tool'])[e.event_id % 6 + 1] AS name,
                       CASE WHEN starts_with(name, 'mem_') THEN substring(name, 5) END AS kind,
                       CASE WHEN e.event_id % 10 <> 0 THEN 'u' || (e.user_id % 20) END AS user_id,
                       'fact ' || e.event_id AS fact,
                       CASE WHEN e.event_id % 3 = 0 THEN 0.9::DOUBLE END AS importance,
                       CASE WHEN e.event_id % 4 = 0 THEN 'cursor' END AS source,
                       CASE WHEN e.event_id % 5 = 0 THEN 'work' END AS namespace,
                       CASE WHEN e.event_id % 7 > 0 THEN e.event_type END AS q,
                       CASE WHEN e.event_id % 8 > 0 THEN e.event_id % 90 END AS lim,
                       CASE WHEN e.event_id % 9 > 0 THEN e.event_id % 30 END AS top_n,
                       CASE WHEN e.event_id % 11 > 0 THEN 'm' || (e.event_id % 600) END AS memory_id
                FROM events e))) c))"""


@register("tool_call_route", with_fixtures(_TOOL_SQL, "memories_fx"))
def q_tool_route(spark, sf_dir):
    return M.route_tool_calls(FX.tool_calls_fx(spark, sf_dir), FX.TOOL_PREFIX, FX.memories_fx(spark, sf_dir), compat=True)


@register("tool_calls", """
    SELECT event_id AS call_id,
           (['mem_store_memory', 'mem_search_memories', 'mem_get_context', 'mem_delete_memory',
             'mem_get_usage', 'other_tool'])[event_id % 6 + 1] AS name,
           CASE WHEN event_id % 10 <> 0 THEN 'u' || (user_id % 20) END AS user_id,
           CASE WHEN event_id % 11 > 0 THEN 'm' || (event_id % 600) END AS memory_id
    FROM events""")
def q_tool_calls(spark, sf_dir):
    """S3: parse {name, arguments} bodies into typed rows."""
    p = M.parse_tool_calls(FX.tool_calls_fx(spark, sf_dir), FX.TOOL_PREFIX)
    return p.select("call_id", "name", F.col("args.user_id").alias("user_id"),
                    F.col("args.memory_id").alias("memory_id"))


@register("cascade_tenant", with_fixtures("""
    SELECT 'api_key' AS kind, k.id AS row_id, k.tenant_id FROM api_keys_fx k WHERE k.tenant_id NOT IN (SELECT id FROM gone)
    UNION ALL
    SELECT 'memory', m.id, m.tenant_id FROM memories_fx m WHERE m.tenant_id NOT IN (SELECT id FROM gone)
    UNION ALL
    SELECT 'log', l.id, l.tenant_id FROM retrieval_logs_fx l WHERE l.tenant_id NOT IN (SELECT id FROM gone)
    UNION ALL
    SELECT 'team', t.id, t.tenant_id FROM teams_fx t WHERE t.tenant_id NOT IN (SELECT id FROM gone)
    UNION ALL
    SELECT 'member', tm.id, NULL FROM team_members_fx tm
    WHERE tm.team_id NOT IN (SELECT id FROM teams_fx WHERE tenant_id IN (SELECT id FROM gone))
    UNION ALL
    SELECT 'feedback', f.seq::VARCHAR, CASE WHEN f.tenant_id IN (SELECT id FROM gone) THEN NULL ELSE f.tenant_id END
    FROM ft f""", "api_keys_fx", "tenants_fx", "memories_fx", "retrieval_logs_fx", "teams_fx", "team_members_fx",
    "feedback_submissions_fx", extra={
        "gone": "SELECT id FROM tenants_fx WHERE memory_limit > 1000000",
        "ft": """SELECT f.seq, k.tenant_id FROM feedback_submissions_fx f
                 LEFT JOIN api_keys_fx k ON starts_with(f.authorization, 'Bearer ')
                                        AND k.key_hash = sha256(substring(f.authorization, 8))"""}))
def q_cascade_tenant(spark, sf_dir):
    """M8 for tenants: delete the tenants above one million memories and
    cascade (keys, memories, logs, teams and their members go; feedback
    keeps its rows with the tenant nulled)."""
    from engram.operators.accounts import feedback_tenant

    tenants = FX.tenants_fx(spark, sf_dir)
    gone = tenants.filter(F.col("memory_limit") > 1000000).select(F.col("id").alias("tenant_id"))
    keys = FX.api_keys_fx(spark, sf_dir)
    fb = feedback_tenant(FX.feedback_submissions_fx(spark, sf_dir), keys).select(
        F.col("seq").cast("string").alias("id"), "tenant_id")
    out = M.cascade_tenant(gone, {
        "api_keys": keys, "memories": FX.memories_fx(spark, sf_dir),
        "retrieval_logs": FX.retrieval_logs_fx(spark, sf_dir), "teams": FX.teams_fx(spark, sf_dir),
        "team_members": FX.team_members_fx(spark, sf_dir), "feedback": fb})
    parts = [("api_key", "api_keys", "tenant_id"), ("memory", "memories", "tenant_id"),
             ("log", "retrieval_logs", "tenant_id"), ("team", "teams", "tenant_id"),
             ("member", "team_members", None), ("feedback", "feedback", "tenant_id")]
    dfs = [out[t].select(F.lit(k).alias("kind"), F.col("id").alias("row_id"),
                         (F.col(c) if c else F.lit(None).cast("string")).alias("tenant_id"))
           for k, t, c in parts]
    res = dfs[0]
    for d in dfs[1:]:
        res = res.unionByName(d)
    return res
