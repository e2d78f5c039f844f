"""Registered streaming queries: each runs a Structured Streaming query over
the shared parquet input to completion (``availableNow``) and returns the
sink table; oracles are the batch operators' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.plans import account_queries, ingest_queries, store_queries, usage_queries
from engram.plans.registry import ORACLES, register
from engram.sources.tables import RAW_SCHEMAS
from engram.streaming import streams as ST


def _events_stream(spark, sf_dir):
    return ST.stream_table(spark, sf_dir, RAW_SCHEMAS["events"], file_glob="events.parquet")


@register("stream_metering", ORACLES["retrieval_metering"])
def q_stream_metering(spark, sf_dir):
    """ST5: the metering aggregate as an event-time windowed stream."""
    ev = _events_stream(spark, sf_dir)
    logs = ev.select(
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("search")).otherwise(F.lit("context"))
        .alias("endpoint"),
        (F.col("event_id") % 11).alias("result_count"), F.col("ts").alias("created_at"))
    out = ST.run_to_table(ST.metering_stream(logs), "metering", mode="complete")
    return out.select("tenant_id", "endpoint", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                      F.col("calls").cast("bigint").alias("calls"), F.col("results").cast("bigint").alias("results"))


@register("stream_rate_limit", ORACLES["rate_limit"])
def q_stream_rate_limit(spark, sf_dir):
    """ST3: the signup throttle as a per-key stateful stream."""
    ev = _events_stream(spark, sf_dir)
    from engram.functions.scalars import epoch_seconds

    secs = epoch_seconds("ts")
    keyed = ev.select(F.concat(F.lit("k"), F.col("user_id") % 3).alias("key"), secs.alias("t"), "event_id")
    return ST.run_to_table(ST.rate_limit_stream(keyed), "rate_limit", mode="append")


__all__ = ["account_queries", "ingest_queries", "store_queries", "usage_queries"]


def _scratch(spark, name: str) -> str:
    import uuid

    return f"{ST._checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:8]}"


@register("stream_store", ORACLES["store_batch"])
def q_stream_store(spark, sf_dir):
    """ST1: the chained arrivals as a file stream, stored per micro-batch
    (foreachBatch M2 + versioned snapshot); returns the outcomes.  Checked
    equal to batch M2 in tests/test_streams.py."""
    from engram.sources import fixtures as FX

    root = _scratch(spark, "st1")
    arrivals = FX.arrivals_fx(spark, sf_dir, chained=True)
    arrivals.write.parquet(f"{root}/in")
    stream = ST.stream_table(spark, f"{root}/in", arrivals.schema)
    ST.ingest_stream(stream, f"{root}/snap", FX.memories_fx(spark, sf_dir), FX.as_of_col(),
                     f"{root}/chk", outcomes_root=f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out/b*")


@register("stream_touch", ORACLES["touch_memories"])
def q_stream_touch(spark, sf_dir):
    """ST2: search results streamed in; access touches per micro-batch."""
    from engram.functions import scalars as S
    from engram.operators import retrieval as R
    from engram.sources import fixtures as FX

    root = _scratch(spark, "st2")
    mem = FX.memories_fx(spark, sf_dir)
    res = R.search(FX.queries_fx(spark, sf_dir), mem, FX.as_of_col(), FX.team_members_fx(spark, sf_dir),
                   FX.teams_fx(spark, sf_dir), keep_raw=True).select("query_id", "id", "raw_similarity")
    res.write.parquet(f"{root}/in")
    stream = ST.stream_table(spark, f"{root}/in", res.schema)
    ST.touch_stream(stream, mem, FX.as_of_col(), f"{root}/out", f"{root}/chk").awaitTermination()
    t = spark.read.parquet(f"{root}/out/latest")
    return t.select("id", "access_count", S.round4("decay_score").alias("decay_score"),
                    F.date_format("last_accessed_at", "yyyy-MM-dd HH:mm:ss").alias("last_accessed_at"))


@register("stream_billing", ORACLES["plan_state"])
def q_stream_billing(spark, sf_dir):
    """ST4: the billing log as a stream, redeliveries dropped, plan state recomputed per micro-batch; returns the last
    state."""
    from engram.operators import billing as B
    from engram.sources import fixtures as FX

    root = _scratch(spark, "st4")
    ev = B.parse_events(FX.billing_events_fx(spark, sf_dir)).drop("payload")
    ev.write.parquet(f"{root}/in")
    stream = ST.stream_table(spark, f"{root}/in", ev.schema)
    ST.billing_stream(stream, FX.billing_tenants_fx(spark, sf_dir), B.plans_table(spark, FX.FIXTURE_PLANS),
                      f"{root}/log", f"{root}/state", f"{root}/chk").awaitTermination()
    return spark.read.parquet(f"{root}/state/latest")


ROWS_OF_A_FILE = 50_000


@register("stream_store_gated", ORACLES["store_pipeline"])
def q_stream_store_gated(spark, sf_dir):
    """ST1 with all gates: the store requests in five micro-batches, each committed as a
    version; returns the outcomes."""
    from engram.plans.store_queries import TEAM_PATTERN
    from engram.session import stored
    from engram.sources import fixtures as FX
    from engram.streaming.snapshots import SnapshotLog, gated_store_stream

    root = _scratch(spark, "st1g")
    requests = stored(FX.store_requests_fx(spark, sf_dir))
    last, n = requests.agg(F.max("arrival_order"), F.count("*")).first()
    files = 1 + n // ROWS_OF_A_FILE  # of each batch
    for k in range(5):  # one after another: files are read in order of their time
        part = requests.filter((F.col("arrival_order") * 5 >= k * (last + 1)) & (F.col("arrival_order") * 5 < (k + 1) * (last + 1)))
        ST.append_files(part, f"{root}/in", files)
    log = SnapshotLog(spark, f"{root}/log")
    log.start(FX.memories_fx(spark, sf_dir))
    stream = ST.stream_table(spark, f"{root}/in", requests.schema, file_glob="*.parquet", max_files=files)
    gated_store_stream(stream, log, FX.store_tenants_fx(spark, sf_dir), FX.team_members_fx(spark, sf_dir), FX.teams_fx(spark, sf_dir),
                       FX.as_of_col(), f"{root}/chk", TEAM_PATTERN).awaitTermination()
    return log.outcomes().select(
        "arrival_id", "arrival_order", "tenant_id", "status", "action", "memory_id", "replaced_id", "similarity", "count_before")


@register("stream_sessions", """
    SELECT tenant_id, user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_call,
           count(*) AS calls, CAST(sum(event_id % 11) AS BIGINT) AS results
    FROM (SELECT *, sum(opens) OVER (PARTITION BY tenant_id, user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k
          FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tenant_id, user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE
                               THEN 0 ELSE 1 END AS opens
                FROM (SELECT 't' || (user_id % 3) AS tenant_id, 'u' || user_id AS user_id, ts, event_id FROM events)))
    GROUP BY tenant_id, user_id, k
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def q_stream_sessions(spark, sf_dir):
    """ST5: a user's sessions in append mode: those that the watermark has closed."""
    ev = _events_stream(spark, sf_dir)
    logs = ev.select(
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), F.concat(F.lit("u"), F.col("user_id")).alias("user_id"),
        (F.col("event_id") % 11).alias("result_count"), F.col("ts").alias("created_at"))
    out = ST.run_to_table(ST.session_stream(logs), "sessions", mode="append")
    stamp = "yyyy-MM-dd HH:mm:ss"
    return out.select("tenant_id", "user_id", F.date_format("w.start", stamp).alias("started"),
                      F.date_format(F.col("w.end") - F.expr("interval 30 minutes"), stamp).alias("last_call"),
                      F.col("calls").cast("bigint").alias("calls"), F.col("results").cast("bigint").alias("results"))
