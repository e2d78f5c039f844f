"""Registered usage / quota / metering queries (A1-A10, F1) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import retrieval as R
from engram.operators import usage as U
from engram.plans.oracle_fixtures import with_fixtures
from engram.plans.registry import register
from engram.sources import fixtures as FX

TS_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


@register("active_memories", with_fixtures("""
    SELECT id, tenant_id, user_id, namespace FROM memories_fx WHERE valid_until IS NULL""",
    "memories_fx"))
def q_active(spark, sf_dir):
    return R.active(FX.memories_fx(spark, sf_dir)).select("id", "tenant_id", "user_id", "namespace")


@register("active_count", with_fixtures("""
    SELECT tenant_id, count(*) AS active_count FROM memories_fx WHERE valid_until IS NULL
    GROUP BY tenant_id""", "memories_fx"))
def q_active_count(spark, sf_dir):
    return U.active_count(FX.memories_fx(spark, sf_dir))


_USED = """(SELECT tenant_id, count(*) AS used FROM memories_fx WHERE valid_until IS NULL
            GROUP BY tenant_id)"""


@register("usage", with_fixtures(f"""
    SELECT t.id AS tenant_id, t.plan, t.memory_limit, coalesce(u.used, 0) AS memories_used,
           greatest(t.memory_limit - coalesce(u.used, 0), 0) AS memories_remaining
    FROM tenants_fx t LEFT JOIN {_USED} u ON u.tenant_id = t.id""", "memories_fx", "tenants_fx"))
def q_usage(spark, sf_dir):
    return U.usage(FX.tenants_fx(spark, sf_dir), FX.memories_fx(spark, sf_dir))


@register("usage_tool", with_fixtures(f"""
    SELECT r.tenant_id, coalesce(t.plan, 'free') AS plan,
           coalesce(t.memory_limit, 10000) AS memory_limit, coalesce(u.used, 0) AS memories_used,
           coalesce(t.memory_limit, 10000) - coalesce(u.used, 0) AS memories_remaining
    FROM (SELECT DISTINCT tenant_id FROM retrieval_logs_fx) r
    LEFT JOIN (SELECT * FROM tenants_fx WHERE id <> 't2') t ON t.id = r.tenant_id
    LEFT JOIN {_USED} u ON u.tenant_id = r.tenant_id""",
    "memories_fx", "tenants_fx", "retrieval_logs_fx"))
def q_usage_tool(spark, sf_dir):
    """Tenant t2's row is left out so the free/10000 default is exercised."""
    ids = FX.retrieval_logs_fx(spark, sf_dir).select("tenant_id").distinct()
    return U.usage_tool(ids, FX.tenants_fx(spark, sf_dir).filter(F.col("id") != "t2"),
                        FX.memories_fx(spark, sf_dir))


@register("admin_stats", with_fixtures(f"""
    SELECT (SELECT count(*) FROM tenants_fx) AS tenants,
           (SELECT count(*) FROM memories_fx WHERE valid_until IS NULL) AS active_memories,
           (SELECT count(*) FROM api_keys_fx) AS api_keys,
           (SELECT {TS_SQL.format(c='min(created_at)')} FROM api_keys_fx) AS first_key_at,
           (SELECT {TS_SQL.format(c='max(created_at)')} FROM api_keys_fx) AS last_key_at""",
    "memories_fx", "tenants_fx", "api_keys_fx"))
def q_admin_stats(spark, sf_dir):
    return U.admin_stats(FX.tenants_fx(spark, sf_dir), FX.memories_fx(spark, sf_dir),
                         FX.api_keys_fx(spark, sf_dir))


@register("memory_count_all", with_fixtures(
    "SELECT count(*) AS total_memories FROM memories_fx", "memories_fx"))
def q_memory_count_all(spark, sf_dir):
    return U.all_memory_count(FX.memories_fx(spark, sf_dir))


@register("team_member_counts", with_fixtures(f"""
    SELECT t.tenant_id, t.id, t.name, t.slug, {TS_SQL.format(c='t.created_at')} AS created_at,
           coalesce(c.n, 0) AS member_count
    FROM teams_fx t LEFT JOIN (SELECT team_id, count(*) AS n FROM team_members_fx GROUP BY team_id) c
      ON c.team_id = t.id""", "teams_fx", "team_members_fx"))
def q_team_member_counts(spark, sf_dir):
    return U.teams_with_counts(FX.teams_fx(spark, sf_dir), FX.team_members_fx(spark, sf_dir))


@register("vote_totals", with_fixtures("""
    SELECT v.id, CASE WHEN f.votes IS NULL THEN 404 ELSE 200 END AS status, v.n AS n_votes,
           f.votes + v.n AS votes
    FROM (SELECT feedback_id AS id, count(*) AS n FROM votes_fx GROUP BY feedback_id) v
    LEFT JOIN feedback_table_fx f ON f.id = v.id""", "votes_fx", "feedback_table_fx"))
def q_vote_totals(spark, sf_dir):
    return U.vote_totals(FX.feedback_table_fx(spark, sf_dir), FX.votes_fx(spark, sf_dir))


@register("retrieval_metering", with_fixtures(f"""
    SELECT tenant_id, endpoint, {TS_SQL.format(c="time_bucket(INTERVAL 1 DAY, created_at)")} AS window_start,
           count(*) AS calls, sum(result_count) AS results
    FROM retrieval_logs_fx GROUP BY ALL""", "retrieval_logs_fx"))
def q_retrieval_metering(spark, sf_dir):
    return U.retrieval_metering(FX.retrieval_logs_fx(spark, sf_dir))
