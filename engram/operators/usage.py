"""Usage, quotas and metering aggregates (A1-A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.scalars import col_
from engram.operators.retrieval import active

FREE_PLAN = ("free", 10000)


def remaining(limit, used, clamp: bool = True) -> Column:
    diff = col_(limit) - col_(used)
    return F.greatest(diff, F.lit(0)) if clamp else diff


def active_count(memories: DataFrame) -> DataFrame:
    """A1: active memories per tenant."""
    return active(memories).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("active_count"))


def usage(tenants: DataFrame, memories: DataFrame) -> DataFrame:
    """A2: plan, limit, used, remaining = max(0, limit - used); tenants with
    no memories show 0.  Partial counts are combined map-side before the
    shuffle on tenant_id, so a hot tenant costs one row per task."""
    counts = active_count(memories)
    t = tenants.select(F.col("id").alias("tenant_id"), "plan", "memory_limit")
    used = F.coalesce(F.col("active_count"), F.lit(0)).cast("bigint")
    return t.join(counts, "tenant_id", "left").select(
        "tenant_id", "plan", F.col("memory_limit").cast("bigint").alias("memory_limit"),
        used.alias("memories_used"),
        remaining(F.col("memory_limit").cast("bigint"), used, True).alias("memories_remaining"))


def usage_tool(tenant_ids: DataFrame, tenants: DataFrame, memories: DataFrame) -> DataFrame:
    """A3: as A2 for tool calls -- unclamped remaining, free/10000 when the
    tenant row is missing."""
    counts = active_count(memories)
    t = tenants.select(F.col("id").alias("tenant_id"), "plan", "memory_limit")
    q = tenant_ids.select("tenant_id").join(t, "tenant_id", "left").join(counts, "tenant_id", "left")
    plan = F.coalesce("plan", F.lit(FREE_PLAN[0]))
    limit = F.coalesce(F.col("memory_limit").cast("bigint"), F.lit(FREE_PLAN[1]).cast("bigint"))
    used = F.coalesce(F.col("active_count"), F.lit(0)).cast("bigint")
    return q.select("tenant_id", plan.alias("plan"), limit.alias("memory_limit"),
                    used.alias("memories_used"), remaining(limit, used, False).alias("memories_remaining"))


def admin_stats(tenants: DataFrame, memories: DataFrame, api_keys: DataFrame) -> DataFrame:
    """A4: tenants, active memories and api keys, one row.  The three global
    aggregates are scalar subqueries (partial + final aggregate each)."""
    n_active = active(memories).select(F.count(F.lit(1))).scalar()
    n_keys = api_keys.select(F.count(F.lit(1))).scalar()
    first_key = api_keys.select(F.min("created_at")).scalar()
    last_key = api_keys.select(F.max("created_at")).scalar()
    return tenants.agg(F.count(F.lit(1)).alias("tenants")).select(
        "tenants", n_active.alias("active_memories"), n_keys.alias("api_keys"),
        F.date_format(first_key, "yyyy-MM-dd HH:mm:ss").alias("first_key_at"),
        F.date_format(last_key, "yyyy-MM-dd HH:mm:ss").alias("last_key_at"))


def all_memory_count(memories: DataFrame) -> DataFrame:
    """A5: every row, soft-deleted included."""
    return memories.agg(F.count(F.lit(1)).alias("total_memories"))


def teams_with_counts(teams: DataFrame, members: DataFrame) -> DataFrame:
    """Each team with its member count (pre-aggregated, then joined),
    rank by created_at within the tenant."""
    counts = members.groupBy("team_id").agg(F.count(F.lit(1)).alias("member_count"))
    return (teams.join(counts, teams["id"] == counts["team_id"], "left")
            .select(teams["tenant_id"], teams["id"], "name", "slug",
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                    F.coalesce("member_count", F.lit(0)).cast("bigint").alias("member_count")))


def vote_totals(feedback: DataFrame, votes: DataFrame) -> DataFrame:
    """+1 per vote (no per-voter dedup).  One row per voted id: 404
    when the id is unknown, else the final votes."""
    per_id = votes.groupBy(F.col("feedback_id").alias("id")).agg(F.count(F.lit(1)).alias("n_votes"))
    f = feedback.select("id", F.col("votes").alias("base_votes"))
    j = per_id.join(f, "id", "left")
    known = F.col("base_votes").isNotNull()
    return j.select("id", F.when(known, F.lit(200)).otherwise(F.lit(404)).alias("status"),
                    F.col("n_votes").cast("bigint").alias("n_votes"),
                    F.when(known, F.col("base_votes") + F.col("n_votes")).cast("bigint").alias("votes"))


def retrieval_metering(logs: DataFrame, window: str = "1 day") -> DataFrame:
    """A10: retrieval calls and returned results per tenant, endpoint and
    tumbling event-time window."""
    g = logs.groupBy("tenant_id", "endpoint", F.window("created_at", window).alias("w")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("result_count").alias("results"))
    return g.select("tenant_id", "endpoint",
                    F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    F.col("calls").cast("bigint").alias("calls"),
                    F.col("results").cast("bigint").alias("results"))
