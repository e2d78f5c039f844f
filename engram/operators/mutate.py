"""Command-log mutations of the memories snapshot: soft delete (M5), patch
(M6), access touches (M7), tenant cascade (M8) and the tool-call router
(T1, S3).

Each takes a batch of commands (``cmd_id`` gives the order) and returns one
outcome per command; ``apply_*`` helpers produce the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import scalars as S

VISIBILITIES = ("private", "team")


def soft_delete(cmds: DataFrame, memories: DataFrame) -> DataFrame:
    """M5: cmds(cmd_id, tenant_id, memory_id).  The first command that hits
    an active row of its tenant -> 204; everything else -> 404."""
    act = memories.filter(F.col("valid_until").isNull()).select(
        F.col("id").alias("memory_id"), F.col("tenant_id").alias("_m_tenant"))
    d = cmds.join(act, "memory_id", "left")
    hit = F.col("_m_tenant").isNotNull() & (F.col("_m_tenant") == F.col("tenant_id"))
    from engram.operators.ingest import prior_count

    d = prior_count(d, ["memory_id"], ["cmd_id"], hit, "_earlier")
    earlier = F.col("_earlier")
    return d.select("cmd_id", "memory_id",
                    F.when(hit & (earlier == 0), F.lit(204)).otherwise(F.lit(404)).alias("status"))


def apply_soft_delete(memories: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    gone = outcomes.filter(F.col("status") == 204).select(F.col("memory_id").alias("id"),
                                                          F.lit(True).alias("_gone"))
    return (memories.join(gone, "id", "left")
            .withColumn("valid_until", F.when(F.col("_gone"), as_of).otherwise(F.col("valid_until")))
            .drop("_gone"))


def patch(cmds: DataFrame, memories: DataFrame) -> DataFrame:
    """M6: cmds(cmd_id, tenant_id, memory_id, visibility?, importance?).

    400 for an invalid field or nothing to update; 404 when the row is not
    active or not the tenant's; else 200 with the row as it is after this
    command: last given visibility / importance so far, and team_id nulled
    once any 'private' has been applied ('team' keeps whatever team_id is
    left)."""
    bad = ((F.col("visibility").isNotNull() & ~F.col("visibility").isin(*VISIBILITIES))
           | (F.col("importance").isNotNull() & ((F.col("importance") < 0) | (F.col("importance") > 1))))
    nothing = F.col("visibility").isNull() & F.col("importance").isNull()
    act = memories.filter(F.col("valid_until").isNull()).select(
        F.col("id").alias("memory_id"), F.col("tenant_id").alias("_m_tenant"),
        F.col("visibility").alias("_vis0"), F.col("importance").alias("_imp0"), F.col("team_id").alias("_team0"))
    d = cmds.join(act, "memory_id", "left")
    found = F.col("_m_tenant").isNotNull() & (F.col("_m_tenant") == F.col("tenant_id"))
    status = F.when(bad | nothing, F.lit(400)).when(~found, F.lit(404)).otherwise(F.lit(200))
    d = d.withColumn("status", status)
    ok = F.col("status") == 200
    from engram.operators.ingest import prior_count, running_last

    private = ok & F.coalesce(F.col("visibility") == "private", F.lit(False))
    d = running_last(d, ["memory_id"], ["cmd_id"], {
        "_vis": F.when(ok, F.col("visibility")), "_imp": F.when(ok, F.col("importance"))})
    d = prior_count(d, ["memory_id"], ["cmd_id"], private, "_priv_before")
    priv = F.col("_priv_before") + private.cast("int")
    return d.select(
        "cmd_id", "memory_id", "status",
        F.when(ok, F.coalesce(F.col("_vis"), F.col("_vis0"))).alias("visibility"),
        F.when(ok, F.coalesce(F.col("_imp"), F.col("_imp0"))).alias("importance"),
        F.when(ok & (priv == 0), F.col("_team0")).alias("team_id"))


def touch(results: DataFrame, memories: DataFrame, as_of: Column, order: str = "query_id") -> DataFrame:
    """M7: every returned row gets last_accessed_at = as_of, access_count +
    times returned, and its stored decay_score overwritten with the raw
    similarity of the last query that returned it.  ``order`` names the
    column that tells which query came last; give a number or a time where
    query ids are text, as text puts q7 after q1007."""
    per = results.groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max_by("raw_similarity", order).alias("_sim"))
    return (memories.join(per, "id", "inner")
            .select("id", (F.col("access_count") + F.col("_n")).cast("bigint").alias("access_count"),
                    F.col("_sim").alias("decay_score"), as_of.alias("last_accessed_at")))


def cascade_tenant(tenant_ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """M8 for tenants: keys, memories, logs and teams (and so their members
    and invitations) are removed; feedback keeps its rows with tenant_id
    nulled."""
    gone = tenant_ids.select("tenant_id").distinct()
    out = {}
    for name in ("api_keys", "memories", "retrieval_logs", "teams"):
        if name in tables:
            out[name] = tables[name].join(gone, "tenant_id", "left_anti")
    if "teams" in tables:
        dead = tables["teams"].join(gone, "tenant_id", "left_semi").select(F.col("id").alias("team_id"))
        for name in ("team_members", "team_invitations"):
            if name in tables:
                out[name] = tables[name].join(dead, "team_id", "left_anti")
    if "feedback" in tables:
        f = tables["feedback"]
        out["feedback"] = (f.join(gone.withColumn("_g", F.lit(True)), "tenant_id", "left")
                           .withColumn("tenant_id", F.when(F.col("_g").isNull(), F.col("tenant_id")))
                           .select(*f.columns))
    return out


# --------------------------------------------------------------------------- tool calls

TOOL_ARGS = ("struct<user_id:string, fact:string, importance:double, source:string, namespace:string, "
             "q:string, limit:bigint, top_n:bigint, memory_id:string>")
TOOL_KINDS = ("store_memory", "search_memories", "get_context", "delete_memory", "get_usage")
REQUIRED = {"store_memory": ("user_id", "fact"), "search_memories": ("user_id", "q"),
            "get_context": ("user_id",), "delete_memory": ("memory_id",), "get_usage": ()}


def parse_tool_calls(calls: DataFrame, prefix: str, body: str = "body") -> DataFrame:
    """S3: {name, arguments} JSON -> kind + typed arguments.  ``prefix`` is
    the tool-name prefix the caller registered its functions under."""
    p = calls.withColumn("_b", F.from_json(F.col(body), f"struct<name:string, arguments:{TOOL_ARGS}>"))
    kind = F.when(F.col("_b.name").startswith(prefix + "_"),
                  F.expr(f"substring(_b.name, {len(prefix) + 2})"))
    return p.select("*", F.col("_b.name").alias("name"), kind.alias("kind"),
                    F.col("_b.arguments").alias("args")).drop("_b")


def checked_tool_calls(calls: DataFrame, prefix: str) -> DataFrame:
    """Parsed calls with ``status``: 400 for an unknown function or a missing
    required argument, 201 for a store, else 200."""
    p = parse_tool_calls(calls, prefix)
    known = F.col("kind").isin(*TOOL_KINDS)
    missing = F.lit(False)
    for kind, req in REQUIRED.items():
        cond = F.lit(False)
        for a in req:
            v = F.col(f"args.{a}")
            cond = cond | v.isNull() | (v == "")
        missing = F.when(F.col("kind") == kind, cond).otherwise(missing)
    status = F.when(~known | F.col("kind").isNull(), F.lit(400)).when(missing, F.lit(400)).otherwise(
        F.when(F.col("kind") == "store_memory", F.lit(201)).otherwise(F.lit(200)))
    return p.withColumn("status", status)


def tool_arguments(compat: bool = True) -> dict[str, Column]:
    """namespace, source and limit of a parsed call, as the service reads them."""
    args = F.col("args")
    is_search = F.col("kind") == "search_memories"
    ns_arg = F.coalesce(args["namespace"], F.lit("default"))
    if compat:
        namespace = F.when(is_search, F.coalesce(args["source"], F.lit("default"))).otherwise(ns_arg)
        source = F.when(is_search, ns_arg).otherwise(args["source"])
    else:
        namespace, source = ns_arg, args["source"]
    limit = (F.when(is_search, F.least(F.coalesce(args["limit"], F.lit(10)), F.lit(50)))
             .when(F.col("kind") == "get_context", F.least(F.coalesce(args["top_n"], F.lit(5)), F.lit(20))))
    return {"namespace": namespace, "source": source, "limit": limit}


def route_tool_calls(calls: DataFrame, prefix: str, memories: DataFrame, compat: bool = True) -> DataFrame:
    """One outcome per call.  Unknown function or missing required
    arguments -> 400.  Store defaults: importance 0.5, source 'openai',
    namespace 'default'.  Search takes limit min(limit ?? 10, 50) and -- as
    the service's positional call does -- filters source by the namespace
    argument and scopes namespace by the source argument (``compat``);
    context uses namespace as given and top_n min(top_n ?? 5, 20).  A delete
    is carried out in call order (M5): 204 when it hits an active memory of
    its tenant, else 404."""
    p = checked_tool_calls(calls, prefix)
    known = F.col("kind").isin(*TOOL_KINDS)
    deletes = p.filter((F.col("kind") == "delete_memory") & (F.col("status") == 200)).select(
        F.col("call_id").alias("cmd_id"), "tenant_id", F.col("args.memory_id").alias("memory_id"))
    done = soft_delete(deletes, memories).select(F.col("cmd_id").alias("call_id"), F.col("status").alias("_deleted"))
    p = p.join(done, "call_id", "left").withColumn("status", F.coalesce("_deleted", "status"))
    status = F.col("status")
    args = F.col("args")
    namespace, source, limit = tool_arguments(compat).values()
    store = F.col("kind") == "store_memory"
    return p.select(
        "call_id", "tenant_id", "name", "kind", status.alias("status"),
        F.when(status == 400, F.when(~known | F.col("kind").isNull(), F.lit("unknown function"))
               .otherwise(F.lit("missing required argument")))
        .when(status == 404, F.lit("memory not found")).alias("reason"),
        args["user_id"].alias("user_id"), args["memory_id"].alias("memory_id"),
        F.when(status < 400, namespace).alias("namespace"),
        F.when(status < 400, F.when(store, F.coalesce(args["source"], F.lit("openai"))).otherwise(source))
        .alias("source"),
        F.when(status < 400, limit).cast("bigint").alias("limit"),
        F.when(status < 400, F.when(store, F.coalesce(args["importance"], F.lit(0.5))))
        .alias("importance"))
