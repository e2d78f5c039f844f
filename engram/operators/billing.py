"""Billing events -> plan state (B1), plan history (B2), highest plan (B3),
and the event parser (S4).

Events are ordered by (ts, event_id).  A checkout with tenant and customer
links the customer to the tenant -- unless another tenant holds that
customer at that moment (the unique index rejects the whole event).  A
checkout with a subscription and a tenant sets the plan of the first
subscription item's price; an invoice does the same for the tenant that
holds the customer at that moment; a deletion downgrades that tenant to
free.  Unknown prices change nothing.

Links that the tenants bring along count as attempts before the whole log.
Only tenants of the table can link or change plan: the update of an unknown
one touches no row.

Link attempts are claims of a unique key (``operators.unique``): only the
contested customers and their tenants are walked in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.operators.retrieval import broadcast_if_small
from engram.operators.unique import claim_keys
from engram.session import ensure_checkpoint_dir, stored

CHECKOUT = "checkout.session.completed"
INVOICE = "invoice.payment_succeeded"
DELETED = "customer.subscription.deleted"
FREE_PLAN = ("free", 10000)
BEFORE_LOG = -(1 << 62)  # the ts of links that exist before the log

EVENT_SCHEMA = ("struct<id:string, type:string, created:bigint, data:struct<object:struct<"
                "customer:string, subscription:string, metadata:map<string,string>, "
                "items:struct<data:array<struct<price:struct<id:string>>>>>>>")


def plans_table(spark: SparkSession, plans: dict[str, tuple[str, int]]) -> DataFrame:
    """price id -> (plan, memory_limit); a handful of rows."""
    rows = [(p, name, int(limit)) for p, (name, limit) in plans.items()]
    return spark.createDataFrame(rows, "price string, plan string, memory_limit bigint")


def parse_events(raw: DataFrame, col: str = "payload") -> DataFrame:
    """JSON event -> typed columns; unparseable rows keep ``rejected``."""
    p = raw.withColumn("_e", F.from_json(F.col(col), EVENT_SCHEMA))
    o = F.col("_e.data.object")
    return p.select(
        "*",
        F.col("_e.id").alias("event_id"), F.col("_e.type").alias("type"),
        F.col("_e.created").alias("ts"),
        o["customer"].alias("customer"), o["subscription"].alias("subscription"),
        o["metadata"]["tenant_id"].alias("tenant_id"),
        F.element_at(o["items"]["data"], 1)["price"]["id"].alias("price"),
        (F.col("_e").isNull() | F.col("_e.type").isNull()).alias("rejected"),
    ).drop("_e")


def initial_links(tenants: DataFrame) -> DataFrame:
    """The links the tenants have before the log, as attempts at ``BEFORE_LOG``."""
    return tenants.filter(F.col("stripe_customer_id").isNotNull()).select(
        F.concat(F.lit("link:"), F.col("id")).alias("event_id"), F.lit(BEFORE_LOG).cast("bigint").alias("ts"),
        F.col("id").alias("tenant_id"), F.col("stripe_customer_id").alias("customer"))


def link_outcomes(events: DataFrame, tenants: DataFrame) -> DataFrame:
    """Link attempts (checkouts of known tenants with a customer, and the
    links from before the log) with ``ok``: claims of customers, each held by
    one tenant, in order of the log."""
    att = stored(events.filter((F.col("type") == CHECKOUT) & F.col("tenant_id").isNotNull()
                               & F.col("customer").isNotNull())
                 .select("event_id", "ts", "tenant_id", "customer")
                 .join(tenants.select(F.col("id").alias("tenant_id")), "tenant_id", "left_semi")
                 .select("event_id", "ts", "tenant_id", "customer")
                 .unionByName(initial_links(tenants)))
    claims = att.select(F.col("event_id").alias("cmd_id"), F.lit("").alias("scope"), F.col("tenant_id").alias("owner"),
                        F.col("customer").alias("key"), "ts")
    granted = claim_keys(claims, order=("ts", "cmd_id")).select(F.col("cmd_id").alias("event_id"), F.col("granted").alias("ok"))
    return stored(att.join(granted, "event_id"))


def _owner_at(events: DataFrame, links: DataFrame) -> DataFrame:
    """For invoice / deletion events: the tenant holding the customer at the
    event (the customer's latest successful claimant, if that tenant has
    not linked another customer since)."""
    ok_links = links.filter("ok").select("event_id", "ts", "tenant_id", "customer")
    probes = events.filter(F.col("type").isin(INVOICE, DELETED) & F.col("customer").isNotNull()).select(
        "event_id", "ts", "customer")
    u = (ok_links.select("customer", "ts", "event_id", F.col("tenant_id").alias("_t"), F.lit(0).alias("_p"))
         .unionByName(probes.select("customer", "ts", "event_id", F.lit(None).cast("string").alias("_t"),
                                    F.lit(1).alias("_p"))))
    w = Window.partitionBy("customer").orderBy("ts", "event_id", "_p").rowsBetween(
        Window.unboundedPreceding, -1)
    cand = (u.withColumn("_cand", F.last(F.when(F.col("_t").isNotNull(), F.struct(
        F.col("_t").alias("t"))), ignorenulls=True).over(w))
        .filter(F.col("_p") == 1).select("event_id", "ts", "customer", F.col("_cand.t").alias("cand")))
    # does the candidate still hold the customer?  its latest successful
    # link before the event must be this customer
    p2 = cand.filter(F.col("cand").isNotNull()).select(
        F.col("cand").alias("tenant_id"), "ts", "event_id", F.lit(1).alias("_p"),
        F.lit(None).cast("string").alias("_c"), F.col("customer").alias("_want"))
    d2 = ok_links.select("tenant_id", "ts", "event_id", F.lit(0).alias("_p"),
                         F.col("customer").alias("_c"), F.lit(None).cast("string").alias("_want"))
    w2 = Window.partitionBy("tenant_id").orderBy("ts", "event_id", "_p").rowsBetween(
        Window.unboundedPreceding, -1)
    return (d2.unionByName(p2).withColumn("_cur", F.last("_c", ignorenulls=True).over(w2))
            .filter((F.col("_p") == 1) & (F.col("_cur") == F.col("_want")))
            .select("event_id", F.col("tenant_id").alias("owner")))


def effective_changes(events: DataFrame, tenants: DataFrame, plans: DataFrame,
                      links: DataFrame | None = None) -> DataFrame:
    """Plan changes that take effect: (tenant_id, ts, event_id, plan,
    memory_limit, kind)."""
    links = link_outcomes(events, tenants) if links is None else links
    rejected = links.filter(~F.col("ok")).select("event_id", F.lit(True).alias("_rej"))
    ev = events.filter(~F.coalesce(F.col("rejected"), F.lit(False))).join(rejected, "event_id", "left")
    owners = _owner_at(events, links)
    ev = ev.join(owners, "event_id", "left")
    ev = ev.join(broadcast_if_small(plans), "price", "left")  # few prices: by key, whole shares of the log would meet in a task
    checkout = ((F.col("type") == CHECKOUT) & F.col("_rej").isNull() & F.col("subscription").isNotNull()
                & F.col("tenant_id").isNotNull() & F.col("plan").isNotNull())
    invoice = ((F.col("type") == INVOICE) & F.col("subscription").isNotNull() & F.col("owner").isNotNull()
               & F.col("plan").isNotNull())
    deleted = (F.col("type") == DELETED) & F.col("owner").isNotNull()
    target = F.when(checkout, F.col("tenant_id")).when(invoice | deleted, F.col("owner"))
    changes = ev.filter(checkout | invoice | deleted).select(
        target.alias("tenant_id"), "ts", "event_id",
        F.when(deleted, F.lit(FREE_PLAN[0])).otherwise(F.col("plan")).alias("plan"),
        F.when(deleted, F.lit(FREE_PLAN[1]).cast("bigint")).otherwise(F.col("memory_limit"))
        .alias("memory_limit"),
        F.col("type").alias("kind"))
    return changes.join(tenants.select(F.col("id").alias("tenant_id")), "tenant_id", "left_semi")


def _typed(events: DataFrame) -> DataFrame:
    """The parsed log's columns, materialised once (every later step reads
    the log several times; parsing JSON again each time is the waste)."""
    ensure_checkpoint_dir(events.sparkSession)
    return events.select("event_id", "type", "ts", "customer", "subscription", "tenant_id", "price",
                         "rejected").checkpoint()


def plan_state(events: DataFrame, tenants: DataFrame, plans: DataFrame) -> DataFrame:
    """B1: each tenant's plan, limit and linked customer after the log."""
    events = _typed(events)
    links = link_outcomes(events, tenants)
    changes = effective_changes(events, tenants, plans, links)
    last = changes.groupBy("tenant_id").agg(F.max_by(F.struct("plan", "memory_limit"),
                                                     F.struct("ts", "event_id")).alias("_p"))
    cust = links.filter("ok").groupBy("tenant_id").agg(F.max_by("customer", F.struct("ts", "event_id")).alias("_c"))
    t = tenants.select(F.col("id").alias("tenant_id"), "plan", "memory_limit", "stripe_customer_id")
    return (t.join(last, "tenant_id", "left").join(cust, "tenant_id", "left")
            .select("tenant_id", F.coalesce(F.col("_p.plan"), F.col("plan")).alias("plan"),
                    F.coalesce(F.col("_p.memory_limit"), F.col("memory_limit")).cast("bigint")
                    .alias("memory_limit"),
                    F.coalesce(F.col("_c"), F.col("stripe_customer_id")).alias("stripe_customer_id")))


def plan_history(events: DataFrame, tenants: DataFrame, plans: DataFrame) -> DataFrame:
    """B2: each effective change as a validity interval [valid_from,
    valid_to) per tenant."""
    c = effective_changes(_typed(events), tenants, plans)
    w = Window.partitionBy("tenant_id").orderBy("ts", "event_id")
    return c.select("tenant_id", "event_id", "plan", "memory_limit", "kind",
                    F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


def highest_plan(items: DataFrame, plans: DataFrame) -> DataFrame:
    """Per subscription the known plan with the largest memory_limit
    (null when no item has a known price)."""
    j = items.join(broadcast_if_small(plans).select("price", "memory_limit"), "price", "left")
    # a plain maximum is aggregated by hash; a struct's would sort every item
    best = j.groupBy("subscription").agg(F.max("memory_limit").alias("memory_limit"))
    names = plans.groupBy("memory_limit").agg(F.min("plan").alias("plan"))
    return best.join(broadcast_if_small(names), "memory_limit", "left").select("subscription", "plan", "memory_limit")
