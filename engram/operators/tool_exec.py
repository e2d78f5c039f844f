"""Tool calls carried out in call order (T1): every search, context and usage
call sees exactly the stores and deletes before it.

Stores are deduplicated like any batch (M2, without gates), and deletes take
part in the same fold: a deleted row no longer answers later stores.  Of the
deletes of one memory only the first that could find it matters -- a row that
is gone does not come back -- so a hot id costs the fold one row.  Deletes of
rows without near neighbours need no fold at all.

The fold gives every row a life: ``born`` and ``died`` in call order.  Reads
are then ordinary scoped joins (R1-R3) with an interval condition, and usage
is a running sum of births and deaths (range-sliced, no window per tenant).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import scalars as S
from engram.operators import ingest as I
from engram.operators import mutate as M
from engram.operators import retrieval as R
from engram.session import ensure_checkpoint_dir, passing, stored

BEFORE_ALL = -1  # born of rows that the batch finds


def _target_births(stores: DataFrame, memories: DataFrame) -> DataFrame:
    """(memory_id, owner, born) of every row that a delete could name."""
    old = R.active(memories).select(F.col("id").alias("memory_id"), F.col("tenant_id").alias("owner"), F.lit(BEFORE_ALL).cast("bigint").alias("born"))
    return old.unionByName(stores.select(F.col("arrival_id").alias("memory_id"), F.col("tenant_id").alias("owner"), F.col("arrival_order").alias("born")))


class ToolRun:
    """A batch of tool calls, folded once; the results by kind are DataFrames.

    calls: call_id (its order), tenant_id, body (JSON) and ``vector``, the
    embedding of the call's fact or query (S6, S7).  A stored memory gets the
    id ``memory_prefix`` + call_id."""

    def __init__(self, calls: DataFrame, memories: DataFrame, as_of, prefix: str, compat: bool = True,
                 memory_prefix: str = "c") -> None:
        ensure_checkpoint_dir(calls.sparkSession)
        self.memories, self.as_of = memories, as_of
        arguments = M.tool_arguments(compat)

        def parsed(some: DataFrame) -> DataFrame:
            return M.checked_tool_calls(some, prefix).select(
                "call_id", "tenant_id", "kind", "status", F.col("args.user_id").alias("user_id"), F.col("args.fact").alias("fact"),
                F.col("args.memory_id").alias("memory_id"), F.col("args.importance").alias("importance"), F.col("args.q").alias("q"),
                *[v.alias(k) for k, v in arguments.items()], "vector", F.lit(None).cast("string").alias("team_id"))

        self.calls = stored(parsed(calls).select("call_id", "tenant_id", "kind", "status", "memory_id"))

        def whole(name: str, status: int = 200) -> DataFrame:
            """Calls of a kind with their vectors, which no other call's are read for: bodies without the
            name (or an escape that may stand for it) are left out before the vectors are joined."""
            named = calls.filter(F.col("body").rlike(name + r"|\\"))
            return parsed(named.join(self.kind(name, status).select("call_id"), "call_id", "left_semi"))

        self.whole = whole
        self.stores = stored(self.whole("store_memory", 201).select(
            F.concat(F.lit(memory_prefix), F.col("call_id")).alias("arrival_id"), F.col("call_id").alias("arrival_order"), "tenant_id", "user_id",
            "namespace", "team_id", "fact", F.col("vector").alias("embedding"),
            F.coalesce("importance", F.lit(0.5)).alias("importance"), F.coalesce("source", F.lit("openai")).alias("source"),
            F.lit(None).cast("string").alias("visibility")))
        self.deletes = self.kind("delete_memory").select("call_id", "tenant_id", "memory_id")
        with passing(calls.sparkSession) as keep:  # what the fold stores on its way is as large as the stores
            self._fold(keep)

    def kind(self, name: str, status: int = 200) -> DataFrame:
        return self.calls.filter((F.col("kind") == name) & (F.col("status") == status))

    def _fold(self, keep) -> None:
        births = _target_births(self.stores, self.memories)
        hits = self.deletes.join(births, "memory_id").filter("tenant_id = owner and born < call_id")
        first = stored(hits.groupBy("memory_id").agg(F.min("call_id").alias("call_id")))
        near = stored(I.near_pairs(self.stores, self.memories))
        nodes = near.select(F.col("src").alias("memory_id")).union(near.select("dst")).distinct()
        contested = first.join(nodes, "memory_id", "left_semi").select(
            F.concat(F.lit("delete "), F.col("call_id")).alias("src"), F.col("call_id").alias("arrival_order"), F.col("memory_id").alias("dst"),
            F.lit("delete").alias("dst_kind"), F.lit(None).cast("bigint").alias("dst_order"), F.lit(None).cast("double").alias("sim"))
        folded = stored(I.fold_edges(near.unionByName(contested)))
        missed = folded.filter("action = 'missing'").select(F.expr("cast(substring(arrival_id, 8) as bigint)").alias("call_id"))
        self.deleted = keep(first.join(missed, "call_id", "left_anti"))  # memory_id, call_id
        done = self.stores.select("arrival_id", "arrival_order", "tenant_id").join(
            folded.filter("action in ('duplicate', 'replaced')"), "arrival_id", "left")
        action = F.coalesce("action", F.lit("stored"))
        self.outcomes = keep(done.select(
            "arrival_id", "arrival_order", "tenant_id", action.alias("action"),
            F.when(action == "duplicate", F.col("target_id")).otherwise(F.col("arrival_id")).alias("memory_id"),
            F.when(action == "replaced", F.col("target_id")).alias("replaced_id"),
            S.round4(F.when(action != "stored", F.col("nearest_sim"))).alias("similarity")))

    def lives(self) -> DataFrame:
        """Every memory that was active before or at some time in the batch, with ``born`` and
        ``died`` (null: outlives the batch)."""
        ends = (self.outcomes.filter("action = 'replaced'").select(F.col("replaced_id").alias("id"), F.col("arrival_order").alias("died"))
                .unionByName(self.deleted.select(F.col("memory_id").alias("id"), F.col("call_id").alias("died"))))
        none = self.outcomes.filter("action <> 'replaced'")  # nothing is closed by time: lives say it
        rows = I.apply_outcomes(R.active(self.memories), self.stores, none.unionByName(
            self.outcomes.filter("action = 'replaced'").withColumn("replaced_id", F.lit(None).cast("string"))), self.as_of)
        born = self.outcomes.select(F.col("arrival_id").alias("id"), F.col("arrival_order").alias("born"))
        return (rows.join(born, "id", "left").withColumn("born", F.coalesce("born", F.lit(BEFORE_ALL).cast("bigint")))
                .join(ends, "id", "left"))

    def snapshot(self) -> DataFrame:
        """The memories after the batch, the deleted and replaced ones closed."""
        gone = self.deleted.select(F.col("memory_id").alias("id"), F.lit(True).alias("_gone"))
        new = I.apply_outcomes(self.memories, self.stores, self.outcomes, self.as_of)
        return new.join(gone, "id", "left").withColumn(
            "valid_until", F.when(F.col("_gone") & F.col("valid_until").isNull(), self.as_of).otherwise(F.col("valid_until"))).select(*new.columns)

    # -- results by kind ------------------------------------------------------------

    def stored(self) -> DataFrame:
        return self.outcomes.select(F.col("arrival_order").alias("call_id"), "action", "memory_id", "replaced_id", "similarity")

    def delete_results(self) -> DataFrame:
        hit = self.deleted.select("call_id", F.lit(204).alias("_hit"))
        return self.deletes.join(hit, "call_id", "left").select("call_id", "memory_id", F.coalesce("_hit", F.lit(404)).alias("status"))

    def _queries(self, kind: str) -> DataFrame:
        return self.whole(kind).select(
            F.col("call_id").alias("query_id"), F.col("call_id").alias("at"), "tenant_id", "user_id", "namespace",
            F.when(F.col("q").isNotNull() & (F.col("q") != ""), F.col("vector")).alias("vector"), F.col("limit").alias("q_limit"), "source",
            F.lit(None).cast("string").alias("team_id"), F.lit(False).alias("include_team"))

    def search_results(self) -> DataFrame:
        return R.search(self._queries("search_memories"), self.lives(), self.as_of, versioned=True)

    def context_results(self) -> DataFrame:
        return R.context(stored(self._queries("get_context")), self.lives(), self.as_of, versioned=True)

    def usage_results(self, tenants: DataFrame) -> DataFrame:
        """used = rows before the batch + births - deaths before the call."""
        plus = self.outcomes.filter("action = 'stored'").select("tenant_id", F.col("arrival_order").alias("call_id"), F.lit(1).alias("change"))
        minus = (self.deletes.select("call_id", "tenant_id").join(self.deleted.select("call_id"), "call_id")
                 .select("tenant_id", "call_id", F.lit(-1).alias("change")))
        asked = self.kind("get_usage").select("tenant_id", "call_id", F.lit(0).alias("change"), F.lit(True).alias("asked"))
        log = asked.unionByName(plus.unionByName(minus), allowMissingColumns=True)
        counted = I.running_sum(log, "tenant_id", ["call_id"], F.col("change"), "_before").filter("asked")
        limits = tenants.select(F.col("id").alias("tenant_id"), "plan", "memory_limit").join(I.active_counts(self.memories), "tenant_id", "full")
        used = F.coalesce("used", F.lit(0)) + F.col("_before")
        limit = F.coalesce("memory_limit", F.lit(10000))
        return counted.join(limits, "tenant_id", "left").select(
            "call_id", F.coalesce("plan", F.lit("free")).alias("plan"), limit.cast("bigint").alias("memory_limit"),
            used.cast("bigint").alias("memories_used"), (limit - used).cast("bigint").alias("memories_remaining"))
