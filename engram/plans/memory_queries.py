"""Registered retrieval queries (R1-R4 and their parts) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import retrieval as R
from engram.plans.oracle_fixtures import AS_OF_SQL, with_fixtures
from engram.plans.registry import register
from engram.sources import fixtures as FX

ISO_SQL = "strftime({c}, '%Y-%m-%dT%H:%M:%S.%gZ')"
DECAY_SQL = (f"exp(-(CAST(date_diff('millisecond', created_at, {AS_OF_SQL}) AS DOUBLE) "
             "/ 86400000.0::DOUBLE) / (greatest(importance, 0.1::DOUBLE) * 10.0::DOUBLE))")


def _gated_sql(qfx: str, default: int, maximum: int) -> str:
    return f"""
        SELECT q.*, (coalesce(q.include_team, false) AND q.team_id IS NOT NULL) AS include,
               least(coalesce(q.q_limit, {default}), {maximum}) AS lim
        FROM {qfx} q
        LEFT JOIN team_access_fx a
          ON a.team_id = q.team_id AND a.user_id = q.user_id AND a.tenant_id = q.tenant_id
        WHERE NOT (coalesce(q.include_team, false) AND q.team_id IS NOT NULL) OR a.role IS NOT NULL"""


SCOPE_SQL = """m.tenant_id = g.tenant_id AND m.namespace = g.namespace
           AND ((NOT g.include AND m.user_id = g.user_id)
                OR (g.include AND ((m.user_id = g.user_id AND m.team_id IS NULL)
                                   OR (m.team_id = g.team_id AND m.visibility = 'team'))))"""


def _search_ctes(gated: str, apply_source: bool = True) -> dict[str, str]:
    source = ("WHERE g.source IS NULL OR g.source = '' OR m.source = g.source"
              if apply_source else "")
    return {
        "mem": """SELECT *, sqrt(list_dot_product(embedding, embedding)) AS norm
                  FROM memories_fx WHERE valid_until IS NULL""",
        "pairs": f"""
            SELECT g.query_id, g.lim, m.id, m.fact, m.importance, m.created_at, m.source, m.namespace,
                   CASE WHEN g.qnorm * m.norm > 0
                        THEN list_dot_product(g.vector, m.embedding) / (g.qnorm * m.norm) END AS sim
            FROM (SELECT *, sqrt(list_dot_product(vector, vector)) AS qnorm FROM {gated}) g
            JOIN mem m ON {SCOPE_SQL}
            {source}""",
        "cands": """
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, id)
                   AS cand_rank
            FROM pairs QUALIFY cand_rank <= 2 * lim""",
        "scored": f"""
            SELECT query_id, lim, cand_rank, id, fact, importance,
                   round({DECAY_SQL}, 4) AS decay_score, round(sim, 4) AS similarity,
                   round(sim * 0.7::DOUBLE + {DECAY_SQL} * 0.3::DOUBLE, 4) AS score,
                   source, namespace, created_at
            FROM cands""",
        "ranked": """
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_rank) AS rnk
            FROM scored""",
    }


RESULT_SELECT = f"""
    SELECT query_id, CAST(rnk AS BIGINT) AS rank, id, fact, importance, decay_score, similarity,
           score, source, namespace, {ISO_SQL.format(c='created_at')} AS created_at
    FROM ranked WHERE rnk <= lim"""


def _search_sql(qfx: str) -> str:
    ctes = {"gated": _gated_sql(qfx, 10, 50), **_search_ctes("gated")}
    return with_fixtures(RESULT_SELECT, "memories_fx", qfx, "team_access_fx", extra=ctes)


def _fixture_tables(spark, sf_dir):
    return (FX.memories_fx(spark, sf_dir), FX.team_members_fx(spark, sf_dir),
            FX.teams_fx(spark, sf_dir))


@register("search", _search_sql("queries_fx"))
def q_search(spark, sf_dir):
    mem, members, teams = _fixture_tables(spark, sf_dir)
    return R.search(FX.queries_fx(spark, sf_dir), mem, FX.as_of_col(), members, teams)


@register("search_team", _search_sql("queries_team_fx"))
def q_search_team(spark, sf_dir):
    mem, members, teams = _fixture_tables(spark, sf_dir)
    return R.search(FX.queries_fx(spark, sf_dir, "team"), mem, FX.as_of_col(), members, teams)


_RECENT_CTES = {
    "gated": _gated_sql("queries_fx", 5, 20),
    "pairs": f"""
        SELECT g.query_id, g.lim, m.id, m.fact, m.importance, m.created_at, m.source, m.namespace
        FROM gated g JOIN memories_fx m ON {SCOPE_SQL} AND m.valid_until IS NULL""",
    "cands": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS cand_rank
        FROM pairs QUALIFY cand_rank <= 2 * lim""",
    "scored": f"""
        SELECT query_id, lim, cand_rank, id, fact, importance, round({DECAY_SQL}, 4) AS decay_score,
               1.0::DOUBLE AS similarity, round({DECAY_SQL}, 4) AS score, source, namespace, created_at
        FROM cands""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_rank) AS rnk
        FROM scored""",
}


@register("recent", with_fixtures(RESULT_SELECT, "memories_fx", "queries_fx", "team_access_fx",
                                  extra=_RECENT_CTES))
def q_recent(spark, sf_dir):
    mem, members, teams = _fixture_tables(spark, sf_dir)
    return R.recent(FX.queries_fx(spark, sf_dir), mem, FX.as_of_col(), members, teams)


def _context_sql() -> str:
    vec = _search_ctes("gv", apply_source=False)
    ctes = {
        "gated": _gated_sql("queries_ctx_fx", 5, 20),
        "gv": "SELECT * FROM gated WHERE vector IS NOT NULL",
        **vec,
        "rpairs": f"""
            SELECT g.query_id, g.lim, m.id, m.fact, m.importance, m.created_at, m.source, m.namespace
            FROM gated g JOIN memories_fx m ON {SCOPE_SQL} AND m.valid_until IS NULL
            WHERE g.vector IS NULL""",
        "rcands": """
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, id) AS cand_rank
            FROM rpairs QUALIFY cand_rank <= 2 * lim""",
        "rscored": f"""
            SELECT query_id, lim, cand_rank, id, fact, importance,
                   round({DECAY_SQL}, 4) AS decay_score, round({DECAY_SQL}, 4) AS score, source
            FROM rcands""",
        "allres": """
            SELECT query_id, lim, cand_rank, id, fact, importance, decay_score, score, source FROM scored
            UNION ALL SELECT * FROM rscored""",
        "res": """
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_rank) AS rnk
            FROM allres QUALIFY rnk <= lim""",
        "lines": """
            SELECT query_id, count(*) AS n,
                   string_agg('[' || rnk || '] (importance: '
                              || regexp_replace(CAST(importance AS VARCHAR), '\\.0$', '')
                              || ', decay: '
                              || CASE WHEN regexp_replace(printf('%.4f', decay_score), '\\.?0+$', '') = ''
                                      THEN '0'
                                      ELSE regexp_replace(printf('%.4f', decay_score), '\\.?0+$', '') END
                              || ', source: ' || source || ') ' || fact, chr(10) ORDER BY rnk) AS context
            FROM res GROUP BY query_id""",
    }
    body = """
        SELECT g.query_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_memories,
               coalesce(l.context, 'No relevant memories found.') AS context
        FROM gated g LEFT JOIN lines l USING (query_id)"""
    return with_fixtures(body, "memories_fx", "queries_ctx_fx", "team_access_fx", extra=ctes)


@register("context", _context_sql())
def q_context(spark, sf_dir):
    mem, members, teams = _fixture_tables(spark, sf_dir)
    return R.context(FX.queries_fx(spark, sf_dir, "context"), mem, FX.as_of_col(), members, teams)


_LIST_BODY = f"""
    SELECT query_id, CAST(pos - q_offset AS BIGINT) AS rank, id, fact, visibility, team_id,
           importance, source, namespace, {ISO_SQL.format(c='created_at')} AS created_at
    FROM (
        SELECT g.query_id, g.q_offset, g.lim, m.*,
               row_number() OVER (PARTITION BY g.query_id ORDER BY m.created_at DESC, m.id) AS pos
        FROM (SELECT *, team_id IS NOT NULL AS include, least(coalesce(q_limit, 20), 100) AS lim,
                     visibility AS vis_filter
              FROM list_queries_fx) g
        JOIN memories_fx m ON {SCOPE_SQL} AND m.valid_until IS NULL
        WHERE g.vis_filter IS NULL OR m.visibility = g.vis_filter
    ) WHERE pos > q_offset AND pos <= q_offset + lim"""


@register("list_memories", with_fixtures(_LIST_BODY, "memories_fx", "list_queries_fx"))
def q_list_memories(spark, sf_dir):
    return R.list_memories(FX.list_queries_fx(spark, sf_dir), FX.memories_fx(spark, sf_dir))


# --------------------------------------------------------------------------- approximate search

IVF_LISTS, IVF_PROBES = 16, 8


def _ivf(spark, sf_dir):
    """The approximate search over an index written for it.  Its centroids are by rule, so
    that the oracle has the same: the vectors j * (n div 16), as unit vectors."""
    import uuid

    from engram.operators import ann
    from engram.session import ensure_checkpoint_dir

    mem, members, teams = _fixture_tables(spark, sf_dir)
    n = mem.count()
    i = F.expr("cast(substring(id, 2) as bigint)")
    cents = mem.filter((i % (n // IVF_LISTS) == 0) & (i < IVF_LISTS * (n // IVF_LISTS))).select(
        (i / (n // IVF_LISTS)).cast("int").alias("cid"), ann._unit(F.col("embedding")).alias("centroid"))
    path = ann.build_index(mem, cents, f"{ensure_checkpoint_dir(spark).rstrip('/')}/ivf-{uuid.uuid4().hex}")
    return ann.ivf_search(FX.queries_fx(spark, sf_dir), path, FX.as_of_col(), IVF_PROBES, members, teams), mem, members, teams


def _ivf_ctes() -> dict[str, str]:
    score = "round(list_dot_product({v}, c.centroid) / sqrt(list_dot_product({v}, {v})), 9) DESC, c.cid"
    exact = _search_ctes("gated")
    return {
        "cents": f"""
            SELECT m.i // (e.n // {IVF_LISTS}) AS cid,
                   list_transform(m.embedding, lambda x: x / sqrt(list_dot_product(m.embedding, m.embedding))) AS centroid
            FROM memories_fx m JOIN emb_n e ON true
            WHERE m.i % (e.n // {IVF_LISTS}) = 0 AND m.i < {IVF_LISTS} * (e.n // {IVF_LISTS})""",
        "gated": _gated_sql("queries_fx", 10, 50),
        "probed": f"""
            SELECT g.*, c.cid AS q_cid FROM gated g JOIN cents c ON true
            QUALIFY row_number() OVER (PARTITION BY g.query_id ORDER BY {score.format(v='g.vector')}) <= {IVF_PROBES}""",
        "mem": exact["mem"],
        "listed": f"""
            SELECT m.*, c.cid FROM mem m JOIN cents c ON true
            QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY {score.format(v='m.embedding')}) = 1""",
        "pairs": exact["pairs"].replace("FROM gated)", "FROM probed)").replace("JOIN mem m ON", "JOIN listed m ON m.cid = g.q_cid AND"),
        **{k: exact[k] for k in ("cands", "scored", "ranked")},
    }


@register("ivf_search", with_fixtures(RESULT_SELECT, "memories_fx", "queries_fx", "team_access_fx", "emb_n", extra=_ivf_ctes()))
def q_ivf_search(spark, sf_dir):
    """V2: R1 over the probed lists of a stored index."""
    return _ivf(spark, sf_dir)[0]


def _recall_ctes() -> dict[str, str]:
    exact = _search_ctes("gated")
    again = {"pairs": "x_pairs", "cands": "x_cands", "scored": "x_scored", "ranked": "x_ranked"}
    out = _ivf_ctes()
    for name, new in again.items():
        sql = exact[name]
        for old in again:
            sql = sql.replace(f"FROM {old}", f"FROM {again[old]}")
        out[new] = sql
    return out


@register("recall_at_k", with_fixtures("""
    SELECT count(*) AS queries, round(avg(recall), 4) AS recall_at_k, 3 AS k FROM (
        SELECT x.query_id, sum(CASE WHEN a.id IS NOT NULL THEN 1 ELSE 0 END) / count(*) AS recall
        FROM (SELECT query_id, id FROM x_ranked WHERE rnk <= lim AND rnk <= 3) x
        LEFT JOIN (SELECT query_id, id FROM ranked WHERE rnk <= lim AND rnk <= 3) a ON a.query_id = x.query_id AND a.id = x.id
        GROUP BY x.query_id)""", "memories_fx", "queries_fx", "team_access_fx", "emb_n", extra=_recall_ctes()))
def q_recall(spark, sf_dir):
    """V3: recall of the approximate top-k (k = the queries' limit) against
    the exact search."""
    from engram.operators import ann

    approx, mem, members, teams = _ivf(spark, sf_dir)
    exact = R.search(FX.queries_fx(spark, sf_dir), mem, FX.as_of_col(), members, teams)
    return ann.recall_at_k(approx, exact, 3)
