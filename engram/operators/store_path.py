"""The whole store path of a batch: validate (C1) -> team gate (M4) -> quota
(M3) -> dedup (M2) -> next snapshot (S5).

Requests come by two routes.  ``api`` requests are validated, gated by team
role and counted against the tenant's quota; ``tool`` requests only need a
user and a fact, and are neither gated nor counted (their rows count, though).

The quota is a cut: a batch of stores never lowers a tenant's active count
(a replacement closes one row and adds one), so from the first request that
finds the count at the limit every gated request of the tenant is refused.
The first fold without refusals is right up to that cut.  Tool requests go on
after it and no longer meet the refused rows, so the tenants that were cut
are folded again without them; that second fold is the result, since their
counts stay at the limit or above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators import ingest as I
from engram.session import ensure_checkpoint_dir, stored
from engram.sources.commands import UUID_PATTERN, memory_reasons
from engram.sources.tables import write_snapshot

DEFAULT_MEMORY_LIMIT = 10000


def validated(requests: DataFrame, uuid_pattern: str = UUID_PATTERN) -> DataFrame:
    """Requests with their defaults and ``status`` 200 or 400: C1 for the api
    route, a user and a fact for tools."""
    tool = F.col("via") == "tool"
    named = F.coalesce(F.length("user_id") > 0, F.lit(False)) & F.coalesce(F.length("fact") > 0, F.lit(False))
    ok = F.when(tool, named).otherwise(F.size(memory_reasons(requests, uuid_pattern)) == 0)
    team = F.when(~tool, F.col("team_id"))  # tools name no team and no visibility
    return (requests.withColumn("status", F.when(ok, F.lit(200)).otherwise(F.lit(400)))
            .withColumn("importance", F.coalesce("importance", F.lit(0.5)))
            .withColumn("source", F.coalesce("source", F.when(tool, F.lit("openai")).otherwise(F.lit("api"))))
            .withColumn("namespace", F.coalesce("namespace", F.lit("default")))
            .withColumn("team_id", team)
            .withColumn("visibility", F.when(~tool, F.col("visibility"))))


def _counted(outcomes: DataFrame, used: DataFrame, tenants: DataFrame) -> DataFrame:
    """Adds count_before (active rows the request finds) and limit."""
    limits = (tenants.select(F.col("id").alias("tenant_id"), "memory_limit")
              .join(used, "tenant_id", "left"))
    g = I.running_sum(outcomes, "tenant_id", ["arrival_order", "arrival_id"],
                      (F.col("action") == "stored").cast("int"), "_before").join(limits, "tenant_id", "left")
    return (g.withColumn("count_before", (F.coalesce("used", F.lit(0)) + F.col("_before")).cast("bigint"))
            .withColumn("limit", F.coalesce("memory_limit", F.lit(DEFAULT_MEMORY_LIMIT)).cast("bigint"))
            .drop("_before", "used", "memory_limit"))


def store_requests(requests: DataFrame, memories: DataFrame, tenants: DataFrame, members: DataFrame,
                   teams: DataFrame, uuid_pattern: str = UUID_PATTERN) -> tuple[DataFrame, DataFrame]:
    """(outcomes, accepted requests with their defaults).

    requests: arrival_id, arrival_order, via, tenant_id, user_id, namespace,
    team_id, visibility, fact, embedding, importance, source.  Outcomes have
    one row per request: status 400 / 403 / 402 / 200 (duplicate) / 201,
    action, memory_id, replaced_id, similarity and, from the quota check on,
    count_before."""
    ensure_checkpoint_dir(requests.sparkSession)
    checked = validated(requests, uuid_pattern)
    gate = I.store_access(checked.filter("status = 200").drop("status"), members, teams).select("arrival_id", F.col("status").alias("_gate"))
    checked = checked.join(gate, "arrival_id", "left").withColumn("status", F.coalesce("_gate", "status")).drop("_gate")
    checked = stored(checked)
    ready = checked.filter("status = 200").drop("status")
    route = ready.select("arrival_id", "via")
    used = I.active_counts(memories)
    edges = stored(I.near_pairs(ready, memories))
    first = _counted(stored(I.store(ready, memories, edges)), used, tenants)
    place = F.struct("arrival_order", "arrival_id")
    cuts = first.filter("count_before >= `limit`").groupBy("tenant_id").agg(F.min(place).alias("cut"))
    refused = stored(ready.filter("via <> 'tool'").join(cuts, "tenant_id").filter(place >= F.col("cut"))
                     .select("arrival_id", "arrival_order", "tenant_id"))
    gone = refused.select("arrival_id")
    again = ready.join(refused.select("tenant_id").distinct(), "tenant_id", "left_semi").join(gone, "arrival_id", "left_anti")
    left = (edges.join(again.select(F.col("arrival_id").alias("src")), "src", "left_semi")
            .join(gone.select(F.col("arrival_id").alias("dst")), "dst", "left_anti"))
    names = ["arrival_id", "arrival_order", "tenant_id", "action", "memory_id", "replaced_id", "similarity"]
    kept = first.join(refused.select("tenant_id").distinct(), "tenant_id", "left_anti").select(names)
    none = F.lit(None).cast("string")
    refusals = refused.select("arrival_id", "arrival_order", "tenant_id", F.lit("refused").alias("action"),
                              none.alias("memory_id"), none.alias("replaced_id"), F.lit(None).cast("double").alias("similarity"))
    if refused.isEmpty():
        done = first.join(route, "arrival_id")
    else:
        every = kept.unionByName(I.store(again, memories, left).select(names)).unionByName(refusals)
        done = _counted(every, used, tenants).join(route, "arrival_id")
    status = (F.when(F.col("action") == "refused", F.lit(402)).when(F.col("via") == "tool", F.lit(201))
              .when(F.col("action") == "duplicate", F.lit(200)).otherwise(F.lit(201)))
    done = done.select(*names, status.alias("status"), "count_before")
    early = checked.filter("status <> 200").select("arrival_id", "arrival_order", "tenant_id", "status")
    outcomes = done.unionByName(early.withColumn("action", F.lit("rejected")), allowMissingColumns=True)
    return stored(outcomes), ready


def next_snapshot(memories: DataFrame, accepted: DataFrame, outcomes: DataFrame, as_of) -> DataFrame:
    """The memories after the batch: replaced rows closed, also those born in
    the batch, and a row for every stored or replacing request."""
    stored = outcomes.filter(F.col("action").isin("stored", "replaced"))
    return I.apply_outcomes(memories, accepted, stored, as_of)


def write_touched(memories: DataFrame, snapshot: DataFrame, outcomes: DataFrame, path: str) -> str:
    """S5 in place: of a snapshot partitioned by tenant at ``path`` only the
    partitions of tenants that the batch changed are rewritten; the others'
    files stay as they are.  ``snapshot`` must not be read from ``path``
    after this call."""
    changed = outcomes.filter(F.col("action").isin("stored", "replaced")).select("tenant_id").distinct()
    return write_snapshot(snapshot.join(changed, "tenant_id", "left_semi").select(memories.columns), path, "tenant_id", "overwrite", touched_only=True)

