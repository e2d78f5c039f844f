"""Registered single-operator queries (S1, P1-P11, F2/F3, W2) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import scalars as S
from engram.operators import retrieval as R
from engram.plans.memory_queries import DECAY_SQL, SCOPE_SQL, _gated_sql
from engram.plans.oracle_fixtures import with_fixtures
from engram.plans.registry import register
from engram.sources import fixtures as FX
from engram.sources.tables import conform

TS_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
TS_SPARK = "yyyy-MM-dd HH:mm:ss"


@register("src_memories", with_fixtures(f"""
    SELECT id, tenant_id, user_id, fact, embedding, importance, decay_score, access_count,
           {TS_SQL.format(c='last_accessed_at')} AS last_accessed_at,
           {TS_SQL.format(c='valid_until')} AS valid_until, {TS_SQL.format(c='created_at')} AS created_at,
           source, namespace, team_id, visibility
    FROM memories_fx""", "memories_fx"))
def q_src_memories(spark, sf_dir):
    """The memories snapshot conformed to the service schema (defaults
    filled), timestamps printed."""
    m = conform(FX.memories_fx(spark, sf_dir), "memories")
    return m.select(*[F.date_format(c, TS_SPARK).alias(c) if c in ("last_accessed_at", "valid_until",
                                                                   "created_at") else c
                      for c in m.columns])


@register("decay_score", with_fixtures(f"""
    SELECT id, greatest(importance, 0.1::DOUBLE) * 10.0::DOUBLE AS strength_days,
           round({DECAY_SQL}, 4) AS decay_score
    FROM memories_fx""", "memories_fx"))
def q_decay(spark, sf_dir):
    m = FX.memories_fx(spark, sf_dir)
    return m.select("id", (F.greatest("importance", F.lit(0.1)) * F.lit(10.0)).alias("strength_days"),
                    S.round4(S.decay("created_at", "importance", FX.as_of_col())).alias("decay_score"))


@register("iso_created", with_fixtures("""
    SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at FROM memories_fx""",
    "memories_fx"))
def q_iso(spark, sf_dir):
    return FX.memories_fx(spark, sf_dir).select("id", S.iso_ms("created_at").alias("created_at"))


_PAIRS_CTES = {
    "gated": _gated_sql("queries_fx", 10, 50),
    "mem": """SELECT *, sqrt(list_dot_product(embedding, embedding)) AS norm
              FROM memories_fx WHERE valid_until IS NULL""",
    "pairs": f"""
        SELECT g.query_id, m.id, m.created_at, m.importance,
               CASE WHEN g.qnorm * m.norm > 0
                    THEN list_dot_product(g.vector, m.embedding) / (g.qnorm * m.norm) END AS sim
        FROM (SELECT *, sqrt(list_dot_product(vector, vector)) AS qnorm FROM gated) g
        JOIN mem m ON {SCOPE_SQL}""",
}


def _pairs(spark, sf_dir, variant="plain"):
    q = R.gate_queries(FX.queries_fx(spark, sf_dir, variant), FX.team_members_fx(spark, sf_dir),
                       FX.teams_fx(spark, sf_dir))
    return R.scoped_pairs(q, FX.memories_fx(spark, sf_dir), with_vector=True)


@register("cosine_pairs", with_fixtures("SELECT query_id, id, round(sim, 4) AS similarity FROM pairs",
                                        "memories_fx", "queries_fx", "team_access_fx", extra=_PAIRS_CTES))
def q_cosine_pairs(spark, sf_dir):
    """P3 over every (query, memory) pair in scope."""
    return _pairs(spark, sf_dir).select("query_id", "id", S.round4("sim").alias("similarity"))


@register("blend_score", with_fixtures(f"""
    SELECT query_id, id, round(sim * 0.7::DOUBLE + {DECAY_SQL} * 0.3::DOUBLE, 4) AS score FROM pairs""",
    "memories_fx", "queries_fx", "team_access_fx", extra=_PAIRS_CTES))
def q_blend(spark, sf_dir):
    """P2 on unrounded similarity and decay, rounded once."""
    p = _pairs(spark, sf_dir)
    return p.select("query_id", "id",
                    S.round4(S.blend("sim", S.decay("created_at", "importance", FX.as_of_col())))
                    .alias("score"))


@register("topk_candidates", with_fixtures("""
    SELECT query_id, CAST(cand_rank AS BIGINT) AS cand_rank, id, round(sim, 4) AS similarity
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC NULLS LAST, id) AS cand_rank
          FROM (SELECT p.*, g.lim FROM pairs p JOIN gated g USING (query_id)))
    WHERE cand_rank <= 2 * lim""", "memories_fx", "queries_fx", "team_access_fx", extra=_PAIRS_CTES))
def q_topk(spark, sf_dir):
    """The 2L candidates by similarity before the re-rank."""
    c = R.topk_candidates(_pairs(spark, sf_dir), 50)
    return c.select("query_id", F.col("cand_rank").cast("bigint"), "id", S.round4("sim").alias("similarity"))


_SCOPE_BODY = f"""
    SELECT g.query_id, m.id
    FROM (SELECT * FROM gated) g JOIN memories_fx m ON {SCOPE_SQL} AND m.valid_until IS NULL"""


@register("scope_private", with_fixtures(_SCOPE_BODY, "memories_fx", "queries_fx", "team_access_fx",
                                         extra={"gated": _gated_sql("queries_fx", 10, 50)}))
def q_scope_private(spark, sf_dir):
    """tenant, user and namespace (the user's own team rows included)."""
    q = R.gate_queries(FX.queries_fx(spark, sf_dir), None, None)
    return R.scoped_pairs(q, FX.memories_fx(spark, sf_dir), with_vector=False).select("query_id", "id")


@register("scope_team", with_fixtures(_SCOPE_BODY, "memories_fx", "queries_team_fx", "team_access_fx",
                                      extra={"gated": _gated_sql("queries_team_fx", 10, 50)}))
def q_scope_team(spark, sf_dir):
    """F3 behind the J2 gate: own rows without a team, or the team's
    shared rows -- as one equi-join on scope keys."""
    q = R.gate_queries(FX.queries_fx(spark, sf_dir, "team"), FX.team_members_fx(spark, sf_dir),
                       FX.teams_fx(spark, sf_dir))
    return R.scoped_pairs(q, FX.memories_fx(spark, sf_dir), with_vector=False).select("query_id", "id")


@register("team_access", with_fixtures("""
    SELECT q.query_id, q.user_id, q.team_id, a.role
    FROM queries_team_fx q LEFT JOIN team_access_fx a
      ON a.team_id = q.team_id AND a.user_id = q.user_id AND a.tenant_id = q.tenant_id""",
    "queries_team_fx", "team_access_fx"))
def q_team_access(spark, sf_dir):
    """Role of (team, user) if the team is the tenant's, else null."""
    q = FX.queries_fx(spark, sf_dir, "team")
    return R.team_access(q, FX.team_members_fx(spark, sf_dir), FX.teams_fx(spark, sf_dir)).select(
        "query_id", "user_id", "team_id", "role")


_PARSED = "TRY_CAST(nullif(regexp_extract(trim(raw), '^[+-]?[0-9]+', 0), '') AS BIGINT)"


def _clamp_sql(default: int, maximum: int) -> str:
    return (f"CASE WHEN raw IS NULL THEN {default} WHEN {_PARSED} >= 0 "
            f"THEN least({_PARSED}, {maximum}) END")


@register("clamp_limits", f"""
    SELECT event_id, raw, {_clamp_sql(10, 50)} AS search_limit, {_clamp_sql(20, 100)} AS list_limit,
           {_clamp_sql(5, 20)} AS context_limit, {_clamp_sql(50, 100)} AS feedback_limit
    FROM (SELECT event_id,
                 CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' || event_id
                      WHEN 2 THEN '-' || (event_id % 7)
                      WHEN 3 THEN CAST(CAST(floor(value * 2) AS BIGINT) AS VARCHAR) || 'px'
                      ELSE CAST(CAST(floor(value * 2) AS BIGINT) AS VARCHAR) END AS raw
          FROM events)""")
def q_clamp(spark, sf_dir):
    """P11 on raw limit strings derived from events (null, junk, negative,
    numbers)."""
    from engram.sources.tables import load_raw

    ev = load_raw(spark, sf_dir, "events")
    raw = (F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string"))
           .when(F.col("event_id") % 5 == 1, F.concat(F.lit("x"), F.col("event_id")))
           .when(F.col("event_id") % 5 == 2, F.concat(F.lit("-"), F.col("event_id") % 7))
           .when(F.col("event_id") % 5 == 3,
                 F.concat(F.floor(F.col("value") * 2).cast("bigint").cast("string"), F.lit("px")))
           .otherwise(F.floor(F.col("value") * 2).cast("bigint").cast("string")))
    e = ev.select("event_id", raw.alias("raw"))
    return e.select("event_id", "raw", *[S.clamp_limit("raw", k).alias(f"{k}_limit")
                                         for k in ("search", "list", "context", "feedback")])
