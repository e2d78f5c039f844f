"""The fixture rules of ``engram.sources.fixtures`` written as DuckDB CTEs.

``with_fixtures(body, *names)`` prefixes a query with the CTEs it needs (and
their dependencies), so each oracle is one self-contained statement over the
pre-registered raw tables.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
EPOCH_SQL = "TIMESTAMP '2024-01-01 00:00:00'"

# name -> (dependencies, CTE body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "emb": ((), """
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"""),
    "emb_n": ((), """
        SELECT count(*) AS n FROM embeddings"""),
    "memories_fx": (("emb",), f"""
        SELECT 'm' || e.vec_id AS id,
               't' || (e.vec_id % 3) AS tenant_id,
               'u' || (e.vec_id % 20) AS user_id,
               CASE WHEN (e.vec_id // 60) % 4 = 0 THEN 'work' ELSE 'default' END AS namespace,
               CASE WHEN (e.vec_id // 7) % 5 = 0 THEN 'team' || (e.vec_id % 3) END AS team_id,
               CASE WHEN (e.vec_id // 7) % 5 = 0 THEN 'team' ELSE 'private' END AS visibility,
               d.text AS fact,
               e.embedding,
               CAST(e.vec_id % 11 AS DOUBLE) / 10.0::DOUBLE AS importance,
               1.0::DOUBLE AS decay_score,
               0::BIGINT AS access_count,
               NULL::TIMESTAMP AS last_accessed_at,
               CASE WHEN e.vec_id % 13 = 0 THEN {EPOCH_SQL} + to_seconds((e.vec_id * 7919) % 2592000)
                    + INTERVAL 1 DAY END AS valid_until,
               {EPOCH_SQL} + to_seconds((e.vec_id * 7919) % 2592000) AS created_at,
               (['api', 'claude-code', 'cursor', 'codex'])[((e.vec_id // 3) % 4) + 1] AS source,
               e.vec_id AS i
        FROM emb e LEFT JOIN documents d ON d.doc_id = e.vec_id % (SELECT count(*) FROM documents)"""),
    "queries_base": (("emb", "emb_n"), """
        SELECT 'q' || a.vec_id AS query_id, a.vec_id AS i,
               't' || (a.vec_id % 3) AS tenant_id,
               'u' || (a.vec_id % 20) AS user_id,
               'default' AS namespace,
               list_transform(list_zip(a.embedding, b.embedding),
                              lambda z: z[1] * 0.6::DOUBLE + z[2] * 0.4::DOUBLE) AS vector,
               3 AS q_limit,
               NULL::VARCHAR AS source
        FROM emb a JOIN emb_n ON true JOIN emb b ON b.vec_id = (a.vec_id + 60) % emb_n.n
        WHERE a.vec_id % 25 = 7"""),
    "queries_fx": (("queries_base",), """
        SELECT query_id, tenant_id, user_id, namespace, vector, q_limit, source,
               NULL::VARCHAR AS team_id, false AS include_team
        FROM queries_base"""),
    "queries_team_fx": (("queries_base",), """
        SELECT query_id, tenant_id, user_id, namespace, vector, q_limit, source,
               'team' || (i % 3) AS team_id, true AS include_team
        FROM queries_base"""),
    "queries_ctx_fx": (("queries_base",), """
        SELECT query_id, tenant_id, user_id, namespace,
               CASE WHEN (i // 25) % 2 = 0 THEN vector END AS vector, q_limit, source,
               NULL::VARCHAR AS team_id, false AS include_team
        FROM queries_base
        UNION ALL
        SELECT 'qx' || i, tenant_id, 'nobody', namespace,
               CASE WHEN (i // 25) % 2 = 0 THEN vector END, q_limit, source,
               NULL::VARCHAR, false
        FROM queries_base WHERE i % 250 = 7"""),
    "list_queries_fx": (("queries_base",), """
        SELECT query_id, tenant_id, user_id, namespace,
               CASE WHEN (i // 25) % 2 = 1 THEN 'team' || (i % 3) END AS team_id,
               CASE WHEN (i // 25) % 4 = 3 THEN 'team' END AS visibility,
               5 AS q_limit, (i // 25) % 3 AS q_offset
        FROM queries_base"""),
    "arrivals_fx": (("memories_fx", "emb", "emb_n"), """
        SELECT 'a' || m.i AS arrival_id, m.i AS arrival_order,
               m.tenant_id, m.user_id, m.namespace, NULL::VARCHAR AS team_id, m.fact,
               list_transform(list_zip(m.embedding, b.embedding),
                              lambda z: z[1] + z[2] * ([0.1, 0.25, 0.6, 0.0]::DOUBLE[])[(m.i % 4) + 1])
                   AS embedding,
               0.5::DOUBLE AS importance, 'api' AS source, NULL::VARCHAR AS visibility
        FROM memories_fx m JOIN emb_n ON true JOIN emb b ON b.vec_id = (m.i + 1) % emb_n.n"""),
    "arrivals_chain_fx": (("arrivals_fx", "memories_fx", "emb_n"), """
        SELECT * FROM arrivals_fx
        UNION ALL
        SELECT 'b' || a.arrival_order, a.arrival_order + emb_n.n, a.tenant_id, a.user_id, a.namespace,
               a.team_id, a.fact, a.embedding, a.importance, a.source, a.visibility
        FROM arrivals_fx a JOIN emb_n ON true WHERE a.arrival_order % 4 IN (1, 2)
        UNION ALL
        SELECT 'c' || a.arrival_order, a.arrival_order + 2 * emb_n.n, a.tenant_id, a.user_id,
               a.namespace, m.team_id, a.fact, a.embedding, a.importance, a.source, a.visibility
        FROM arrivals_fx a JOIN emb_n ON true JOIN memories_fx m ON m.i = a.arrival_order
        WHERE a.arrival_order % 4 = 1 AND m.team_id IS NOT NULL"""),
    "store_requests_fx": (("arrivals_chain_fx", "arrivals_fx", "emb", "emb_n"), """
        SELECT arrival_id, arrival_order,
               CASE WHEN arrival_order % 5 = 3 AND team_id IS NULL THEN 'tool' ELSE 'api' END AS via,
               tenant_id, user_id, namespace, team_id,
               CASE arrival_order % 6 WHEN 1 THEN 'private' WHEN 2 THEN 'team' END AS visibility,
               fact, embedding,
               CASE WHEN arrival_order % 17 = 0 THEN 1.5::DOUBLE
                    WHEN arrival_order % 3 > 0 THEN 0.75::DOUBLE END AS importance,
               CASE WHEN arrival_order % 4 <> 1 THEN 'cursor' END AS source
        FROM (SELECT arrival_id, arrival_order, tenant_id, user_id, namespace, team_id, fact, embedding
              FROM arrivals_chain_fx
              UNION ALL
              SELECT 'd' || a.arrival_order, a.arrival_order + 3 * emb_n.n, a.tenant_id, a.user_id,
                     a.namespace, a.team_id, a.fact,
                     list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1] + z[2] * 0.25::DOUBLE)
              FROM arrivals_fx a JOIN emb_n ON true JOIN emb b ON b.vec_id = (a.arrival_order + 2) % emb_n.n
              WHERE a.arrival_order % 4 = 2)"""),
    "store_tenants_fx": (("memories_fx", "emb_n"), """
        SELECT m.tenant_id AS id,
               CASE m.tenant_id WHEN 't0' THEN m.used + emb_n.n // 32 WHEN 't1' THEN m.used + emb_n.n // 16 END
                   AS memory_limit
        FROM (SELECT tenant_id, count(*) FILTER (WHERE valid_until IS NULL) AS used FROM memories_fx
              GROUP BY tenant_id) m JOIN emb_n ON true"""),
    "tenants_fx": (("memories_fx",), f"""
        SELECT tenant_id AS id, 'tenant ' || tenant_id AS name,
               (['free', 'developer', 'pro'])[CAST(substring(tenant_id, 2) AS INTEGER) + 1] AS plan,
               ([100, 200000, 2000000]::BIGINT[])[CAST(substring(tenant_id, 2) AS INTEGER) + 1]
                   AS memory_limit,
               {EPOCH_SQL} AS created_at, NULL::VARCHAR AS stripe_customer_id,
               tenant_id || '@example.com' AS email,
               CAST(1 + 2 * CAST(substring(tenant_id, 2) AS INTEGER) AS BIGINT) AS team_limit,
               3::BIGINT AS members_per_team_limit,
               2::BIGINT AS agent_limit, 0::BIGINT AS custom_skill_limit
        FROM (SELECT DISTINCT tenant_id FROM memories_fx)"""),
    "teams_fx": (("memories_fx",), f"""
        SELECT team_id AS id, 't' || substring(team_id, 5) AS tenant_id,
               'Team ' || substring(team_id, 5) AS name, 'team-' || substring(team_id, 5) AS slug,
               {EPOCH_SQL} AS created_at
        FROM (SELECT DISTINCT team_id FROM memories_fx WHERE team_id IS NOT NULL)"""),
    "team_members_fx": (("memories_fx",), f"""
        SELECT team_id || ':' || user_id AS id, team_id, user_id,
               user_id || '@example.com' AS email,
               (['admin', 'member', 'read_only'])[CAST(substring(user_id, 2) AS INTEGER) % 3 + 1] AS role,
               NULL::VARCHAR AS invited_by,
               {EPOCH_SQL} + to_minutes(CAST(substring(user_id, 2) AS INTEGER)) AS joined_at
        FROM (SELECT DISTINCT team_id, user_id FROM memories_fx WHERE team_id IS NOT NULL)
        WHERE CAST(substring(user_id, 2) AS INTEGER) % 2 = 0"""),
    "api_keys_fx": (("tenants_fx",), f"""
        SELECT 'k' || id AS id, id AS tenant_id, sha256('key_' || id) AS key_hash,
               'fixture key' AS label, {EPOCH_SQL} AS created_at, NULL::TIMESTAMP AS last_used_at
        FROM tenants_fx"""),
    "retrieval_logs_fx": ((), """
        SELECT 'r' || event_id AS id, 't' || (user_id % 3) AS tenant_id, 'u' || user_id AS user_id,
               CASE WHEN event_type IN ('click', 'view') THEN 'search' ELSE 'context' END AS endpoint,
               event_id % 11 AS result_count, ts AS created_at
        FROM events"""),
    "feedback_submissions_fx": ((), f"""
        SELECT doc_id AS seq,
               (['feature', 'bug', 'general', 'other'])[doc_id % 4 + 1] AS type,
               substring(text, 1, CASE WHEN doc_id % 3 > 0 THEN 100 ELSE 210 END) AS title,
               text AS description,
               CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'd' || doc_id || '@example.com' END AS email,
               CASE WHEN doc_id % 2 = 0 THEN 'Bearer key_t' || (doc_id % 4) END AS authorization,
               {EPOCH_SQL} + to_minutes(doc_id) AS created_at
        FROM documents"""),
    "feedback_table_fx": ((), f"""
        SELECT 'f' || doc_id AS id, NULL::VARCHAR AS tenant_id,
               (['feature', 'bug', 'general'])[doc_id % 3 + 1] AS type,
               substring(text, 1, 100) AS title, text AS description, NULL::VARCHAR AS email,
               (['new', 'reviewed', 'planned', 'done', 'wontfix'])[doc_id % 5 + 1] AS status,
               CAST(1 + (doc_id * 37) % 50 AS BIGINT) AS votes, '{{}}' AS metadata,
               {EPOCH_SQL} + to_minutes(doc_id) AS created_at
        FROM documents"""),
    "votes_fx": ((), """
        SELECT event_id AS vote_id, 'f' || (event_id % 300) AS feedback_id, ts AS voted_at FROM events"""),
    "auth_requests_fx": ((), """
        SELECT event_id AS request_id,
               CASE WHEN event_id % 9 = 0 THEN 'key_t' || (user_id % 4)
                    ELSE 'Bearer key_t' || (user_id % 4) END AS authorization, ts
        FROM events"""),
    "signups_fx": ((), """
        SELECT c_custkey AS seq, 'ip' || (c_custkey % 7) AS ip,
               CAST(1704067200 + c_custkey * 97 AS BIGINT) AS t,
               CASE WHEN c_custkey % 17 = 0 THEN 'user' || (c_custkey % 50) || 'mail.com'
                    WHEN c_custkey % 23 = 0 THEN 't' || (c_custkey % 3) || '@example.com'
                    WHEN c_custkey % 6 = 0 THEN ' User' || (c_custkey % 50) || '@Mail.COM '
                    WHEN c_custkey % 2 = 0 THEN 'User' || (c_custkey % 50) || '@Mail.COM'
                    ELSE 'user' || (c_custkey % 50) || '@mail.com' END AS email,
               CASE WHEN c_custkey % 4 > 0 THEN 'https://ref' || (c_custkey % 3) || '.example' END
                   AS referrer
        FROM customer"""),
    "rate_events_fx": ((), """
        SELECT 'k' || (user_id % 3) AS key, epoch_us(ts) // 1000000 AS t, event_id FROM events"""),
    "team_cmds_fx": ((), """
        SELECT event_id AS cmd_id, 't' || (user_id % 3) AS tenant_id,
               'team' || CASE WHEN event_id % 11 = 0 THEN (user_id + 1) % 3 ELSE user_id % 3 END AS team_id,
               'u' || ((event_id // 3) % 20) AS actor, 'u' || (event_id % 20) AS target,
               CASE WHEN event_id % 5 = 0 THEN NULL
                    ELSE (['admin', 'member', 'read_only', 'owner'])[event_id % 4 + 1] END AS role,
               CASE WHEN event_id % 17 = 0 THEN '' ELSE 'Team ' || event_id END AS name,
               CASE WHEN event_id % 13 = 0 THEN 'Bad Slug' ELSE 'team-' || (event_id % 7) END AS slug,
               CASE WHEN event_id % 19 = 0 THEN 'broken' ELSE ' E' || event_id || '@Example.com' END AS email
        FROM events"""),
    "invitations_fx": ((), f"""
        SELECT 'inv' || doc_id AS id, 'team' || (doc_id % 3) AS team_id, 'd' || doc_id || '@example.com' AS email,
               (['admin', 'member', 'read_only'])[doc_id % 3 + 1] AS role, 'tok' || doc_id AS token,
               {EPOCH_SQL} + to_days(CAST(doc_id % 60 AS INTEGER)) AS expires_at,
               CASE WHEN doc_id % 7 = 0 THEN {EPOCH_SQL} END AS accepted_at, {EPOCH_SQL} AS created_at
        FROM documents"""),
    "accepts_fx": ((), """
        SELECT event_id AS cmd_id, 'tok' || (event_id % ((SELECT count(*) FROM documents) + 50)) AS token,
               'u' || (user_id % 20) AS user_id,
               CASE WHEN event_id % 2 = 1 THEN 'a' || event_id || '@example.com' END AS email
        FROM events"""),
    "memory_cmds_fx": (("emb_n",), """
        SELECT e.event_id AS cmd_id,
               't' || CASE WHEN e.event_id % 7 = 0 THEN (e.event_id % (n.n + 20) + 1) % 3
                           ELSE (e.event_id % (n.n + 20)) % 3 END AS tenant_id,
               'm' || (e.event_id % (n.n + 20)) AS memory_id,
               (['private', 'team', NULL, NULL, 'public'])[e.event_id % 5 + 1] AS visibility,
               ([NULL, 0.25, 1.5, 0.75]::DOUBLE[])[e.event_id % 4 + 1] AS importance
        FROM events e JOIN emb_n n ON true"""),
    "tool_log_fx": (("emb", "emb_n"), """
        SELECT c.call_id, c.tenant_id, c.kind, c.user_id, c.fact, c.importance, c.source, c.namespace, c.q,
               c.lim, c.top_n, c.memory_id,
               list_transform(list_zip(e1.embedding, e2.embedding), lambda z: z[1] + z[2] * c.b) AS vector
        FROM (
            SELECT event_id AS call_id, 't' || (user_id % 3) AS tenant_id, event_id % 6 AS kind,
                   CASE WHEN event_id % 13 <> 0 THEN 'u' || (user_id % 20) END AS user_id,
                   'fact ' || event_id AS fact,
                   CASE WHEN event_id % 4 = 0 THEN 0.75::DOUBLE END AS importance,
                   CASE WHEN event_id % 6 = 1 AND event_id % 10 < 5 THEN 'default'
                        WHEN event_id % 6 = 0 AND event_id % 12 > 0 THEN 'default' END AS source,
                   CASE WHEN event_id % 5 = 0 AND event_id % 6 <> 1 THEN 'work' END AS namespace,
                   CASE WHEN event_id % 6 = 1 OR (event_id // 6) % 2 = 0 THEN event_type END AS q,
                   CASE WHEN event_id % 8 > 0 THEN event_id % 90 END AS lim,
                   CASE WHEN event_id % 9 > 0 THEN event_id % 30 END AS top_n,
                   CASE WHEN event_id % 6 = 3 THEN
                        CASE WHEN (event_id // 6) % 3 = 1 THEN 'c' || (event_id - 3 - 6 * (event_id % 4))
                             ELSE 'm' || (user_id % 60 + 60 * (event_id % (emb_n.n // 60))) END END AS memory_id,
                   user_id % 60 + 60 * (event_id % (emb_n.n // 60)) AS k,
                   ([0.1, 0.25, 0.6, 0.0]::DOUBLE[])[(event_id // 6) % 4 + 1] AS b
            FROM events JOIN emb_n ON true) c JOIN emb_n ON true
        LEFT JOIN emb e1 ON e1.vec_id = c.k LEFT JOIN emb e2 ON e2.vec_id = (c.k + 1) % emb_n.n"""),
    "team_access_fx": (("team_members_fx", "teams_fx"), """
        SELECT tm.team_id, tm.user_id, t.tenant_id, tm.role
        FROM team_members_fx tm JOIN teams_fx t ON t.id = tm.team_id"""),
}


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_fixtures(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named fixture CTEs and then ``extra`` CTEs
    (in the given order)."""
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in _order(names)]
    for n, sql in (extra or {}).items():
        parts.append(f"{n} AS ({sql}\n)")
    return "WITH " + ",\n".join(parts) + "\n" + body
