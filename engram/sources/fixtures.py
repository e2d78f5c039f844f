"""Derived inputs (FIXTURES.md) built from the shared test tables.

The service keeps its state in tables the test data does not have (memories,
tenants, teams, ...), so each is derived here from a given table by integer
rules that DuckDB evaluates the same way (``engram.plans.oracle_fixtures``).
Every fixture grows with its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.vectors import as_double
from engram.sources.tables import load_raw

# Fixed values of the fixture rules.
AS_OF = "2024-01-31 00:00:00"
EPOCH = "2024-01-01 00:00:00"
SOURCES = ["api", "claude-code", "cursor", "codex"]
ARRIVAL_MIX = [0.1, 0.25, 0.6, 0.0]          # b for arrival kind i % 4
FEEDBACK_TYPES = ["feature", "bug", "general", "other"]
TENANT_PLANS = [("t0", "free", 100), ("t1", "developer", 200000), ("t2", "pro", 2000000)]
ROLES = ["admin", "member", "read_only"]


def as_of_col():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _pick(values: list, index_expr: str):
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.expr(index_expr) + 1).cast("int"))


def _embedding_count(e: DataFrame):
    return e.select(F.count(F.lit(1))).scalar()


def memories_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_raw(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    # every document is some memories' fact, whole
    docs = load_raw(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("fact"))
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    # texts that no memory can take are not shuffled
    wanted = e.select((F.col("vec_id") % n_docs).alias("d")).select(F.struct(F.min("d").alias("lo"), F.max("d").alias("hi"))).scalar()
    docs = docs.filter(F.col("doc_id").between(wanted["lo"], wanted["hi"]))
    created = F.expr(f"timestampadd(SECOND, (vec_id * 7919) % 2592000, TIMESTAMP_NTZ'{EPOCH}')")
    team = F.when(F.expr("(vec_id div 7) % 5 = 0"), F.concat(F.lit("team"), F.col("vec_id") % 3))
    m = e.withColumn("doc_id", F.col("vec_id") % n_docs).join(docs, "doc_id", "left")
    return m.select(
        F.concat(F.lit("m"), F.col("vec_id")).alias("id"),
        F.concat(F.lit("t"), F.col("vec_id") % 3).alias("tenant_id"),
        F.concat(F.lit("u"), F.col("vec_id") % 20).alias("user_id"),
        F.when(F.expr("(vec_id div 60) % 4 = 0"), F.lit("work")).otherwise(F.lit("default"))
        .alias("namespace"),
        team.alias("team_id"),
        F.when(team.isNotNull(), F.lit("team")).otherwise(F.lit("private")).alias("visibility"),
        F.col("fact"),
        as_double("embedding").alias("embedding"),
        ((F.col("vec_id") % 11).cast("double") / F.lit(10.0)).alias("importance"),
        F.lit(1.0).alias("decay_score"),
        F.lit(0).cast("bigint").alias("access_count"),
        F.lit(None).cast("timestamp_ntz").alias("last_accessed_at"),
        F.when(F.col("vec_id") % 13 == 0, F.expr(
            f"timestampadd(DAY, 1, timestampadd(SECOND, (vec_id * 7919) % 2592000, "
            f"TIMESTAMP_NTZ'{EPOCH}'))")).alias("valid_until"),
        created.alias("created_at"),
        _pick(SOURCES, "(vec_id div 3) % 4").alias("source"),
    )


def _queries_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load_raw(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = _embedding_count(e)
    base = e.filter(F.col("vec_id") % 25 == 7).withColumn("j", (F.col("vec_id") + 60) % n)
    other = e.select(F.col("vec_id").alias("j"), F.col("embedding").alias("e2"))
    q = base.join(other, "j")
    vector = F.zip_with(as_double("embedding"), as_double("e2"),
                        lambda x, y: x * F.lit(0.6) + y * F.lit(0.4))
    return q.select(
        F.concat(F.lit("q"), F.col("vec_id")).alias("query_id"),
        F.col("vec_id").alias("i"),
        F.concat(F.lit("t"), F.col("vec_id") % 3).alias("tenant_id"),
        F.concat(F.lit("u"), F.col("vec_id") % 20).alias("user_id"),
        F.lit("default").alias("namespace"),
        vector.alias("vector"),
        F.lit(3).alias("q_limit"),
        F.lit(None).cast("string").alias("source"),
    )


def queries_fx(spark: SparkSession, sf_dir: str, variant: str = "plain") -> DataFrame:
    """Retrieval queries: rows i % 25 = 7, vector 0.6 v_i + 0.4 v_((i+60) % n).

    variant: ``plain``; ``team`` (include_team with team i % 3); ``context``
    (every other query without a vector, plus unknown-user queries)."""
    team = variant == "team"
    out = _queries_base(spark, sf_dir).select(
        "*",
        (F.concat(F.lit("team"), F.col("i") % 3) if team else F.lit(None).cast("string"))
        .alias("team_id"),
        F.lit(team).alias("include_team"),
    )
    if variant == "context":
        out = out.withColumn("vector", F.when(F.expr("(i div 25) % 2 = 0"), F.col("vector")))
        unknown = (out.filter(F.col("i") % 250 == 7)
                   .withColumn("query_id", F.concat(F.lit("qx"), F.col("i")))
                   .withColumn("user_id", F.lit("nobody")))
        out = out.unionByName(unknown)
    return out.drop("i")


def list_queries_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4 queries: team form for every other block, a visibility filter for
    every fourth block, limit 5, offset (i div 25) % 3."""
    return _queries_base(spark, sf_dir).select(
        "query_id", "tenant_id", "user_id", "namespace",
        F.when(F.expr("(i div 25) % 2 = 1"), F.concat(F.lit("team"), F.col("i") % 3)).alias("team_id"),
        F.when(F.expr("(i div 25) % 4 = 3"), F.lit("team")).alias("visibility"),
        F.lit(5).alias("q_limit"),
        F.expr("(i div 25) % 3").alias("q_offset"),
    )


def arrivals_fx(spark: SparkSession, sf_dir: str, chained: bool = False) -> DataFrame:
    """Facts to store: row i's scope, vector v_i + b v_((i+1) % n), b by i % 4.

    ``chained`` adds second copies of kinds 1 and 2 at order n + i and a
    team-scoped set (rows with a team, kind 1) at order 2n + i."""
    m = memories_fx(spark, sf_dir).withColumn("i", F.expr("cast(substring(id, 2) as bigint)"))
    e = load_raw(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("j"), as_double("embedding").alias("e2"))
    n = _embedding_count(e)
    base = m.withColumn("j", (F.col("i") + 1) % n).join(e, "j")
    b = F.element_at(F.array(*[F.lit(x) for x in ARRIVAL_MIX]), (F.col("i") % 4 + 1).cast("int"))
    vec = F.zip_with(F.col("embedding"), F.col("e2"), lambda x, y: x + y * b)

    def shaped(df, prefix, order, team_col):
        return df.select(
            F.concat(F.lit(prefix), F.col("i")).alias("arrival_id"),
            order.cast("bigint").alias("arrival_order"),
            "tenant_id", "user_id", "namespace",
            team_col.alias("team_id"),
            "fact", vec.alias("embedding"),
            F.lit(0.5).alias("importance"),
            F.lit("api").alias("source"),
            F.lit(None).cast("string").alias("visibility"),
        )

    out = shaped(base, "a", F.col("i"), F.lit(None).cast("string"))
    if chained:
        again = base.filter(F.col("i") % 4 < 3).filter(F.col("i") % 4 > 0)
        out = out.unionByName(shaped(again, "b", F.col("i") + n, F.lit(None).cast("string")))
        teamed = base.filter((F.col("i") % 4 == 1) & F.col("team_id").isNotNull())
        out = out.unionByName(shaped(teamed, "c", F.col("i") + 2 * n, F.col("team_id")))
    return out


def store_requests_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store requests: the chained arrivals and, at order 3n + i, for i % 4 =
    2, one near the arrival of order i (plus 0.25 v_((i+2) % n)), which replaces it.
    Every fifth without a team comes by a tool.  Importance by order % 17 (1.5
    is invalid) and % 3 (none), visibility by % 6, no source when % 4 = 1."""
    base = arrivals_fx(spark, sf_dir, chained=True)
    e = load_raw(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("j"), as_double("embedding").alias("e2"))
    n = _embedding_count(e)
    near = base.filter((F.col("arrival_order") < n) & (F.col("arrival_order") % 4 == 2)).withColumn("j", (F.col("arrival_order") + 2) % n).join(e, "j")
    near = (near.withColumn("arrival_id", F.concat(F.lit("d"), F.col("arrival_order")))
            .withColumn("arrival_order", F.col("arrival_order") + 3 * n)
            .withColumn("embedding", F.zip_with("embedding", "e2", lambda x, y: x + y * F.lit(0.25))))
    o = F.col("arrival_order")
    return base.unionByName(near.select(base.columns)).select(
        "arrival_id", "arrival_order",
        F.when((o % 5 == 3) & F.col("team_id").isNull(), F.lit("tool")).otherwise(F.lit("api")).alias("via"),
        "tenant_id", "user_id", "namespace", "team_id",
        F.when(o % 6 == 1, F.lit("private")).when(o % 6 == 2, F.lit("team")).alias("visibility"),
        "fact", "embedding",
        F.when(o % 17 == 0, F.lit(1.5)).when(o % 3 > 0, F.lit(0.75)).alias("importance"),
        F.when(o % 4 != 1, F.lit("cursor")).alias("source"))


def store_tenants_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants whose quota a batch reaches: t0 and t1 may add a 32nd and a
    16th of the number of vectors to what they have, t2 has no limit of its own."""
    m = memories_fx(spark, sf_dir).groupBy("tenant_id").agg(F.count(F.when(F.col("valid_until").isNull(), 1)).alias("used"))
    n = _embedding_count(load_raw(spark, sf_dir, "embeddings"))
    return m.select(F.col("tenant_id").alias("id"),
                    F.when(F.col("tenant_id") == "t0", F.col("used") + F.floor(n / 32))
                    .when(F.col("tenant_id") == "t1", F.col("used") + F.floor(n / 16)).alias("memory_limit"))


def tenants_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenants t0..t2 from the memories' tenant ids; plan by number."""
    m = memories_fx(spark, sf_dir).select("tenant_id").distinct()
    k = F.expr("cast(substring(tenant_id, 2) as int)")
    plan = F.element_at(F.array(*[F.lit(p) for _, p, _ in TENANT_PLANS]), k + 1)
    limit = F.element_at(F.array(*[F.lit(x).cast("bigint") for _, _, x in TENANT_PLANS]), k + 1)
    return m.select(
        F.col("tenant_id").alias("id"), F.concat(F.lit("tenant "), F.col("tenant_id")).alias("name"),
        plan.alias("plan"), limit.alias("memory_limit"),
        F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("string").alias("stripe_customer_id"),
        F.concat(F.col("tenant_id"), F.lit("@example.com")).alias("email"),
        (F.lit(1) + 2 * k).cast("bigint").alias("team_limit"),
        F.lit(3).cast("bigint").alias("members_per_team_limit"),
        F.lit(2).cast("bigint").alias("agent_limit"),
        F.lit(0).cast("bigint").alias("custom_skill_limit"),
    )


def teams_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One team per tenant: team k belongs to tenant tk."""
    m = memories_fx(spark, sf_dir).filter(F.col("team_id").isNotNull()).select("team_id").distinct()
    k = F.expr("substring(team_id, 5)")
    return m.select(
        F.col("team_id").alias("id"), F.concat(F.lit("t"), k).alias("tenant_id"),
        F.concat(F.lit("Team "), k).alias("name"), F.concat(F.lit("team-"), k).alias("slug"),
        F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"),
    )


def team_members_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of team memories with an even user number are members;
    role by number % 3; joined in order of the number."""
    m = (memories_fx(spark, sf_dir).filter(F.col("team_id").isNotNull())
         .select("team_id", "user_id").distinct())
    num = F.expr("cast(substring(user_id, 2) as int)")
    return m.filter(num % 2 == 0).select(
        F.concat(F.col("team_id"), F.lit(":"), F.col("user_id")).alias("id"),
        "team_id", "user_id",
        F.concat(F.col("user_id"), F.lit("@example.com")).alias("email"),
        F.element_at(F.array(*[F.lit(r) for r in ROLES]), (num % 3 + 1).cast("int")).alias("role"),
        F.lit(None).cast("string").alias("invited_by"),
        F.expr(f"timestampadd(MINUTE, cast(substring(user_id, 2) as int), TIMESTAMP_NTZ'{EPOCH}')")
        .alias("joined_at"),
    )


def api_keys_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tenants_fx(spark, sf_dir)
    return t.select(
        F.concat(F.lit("k"), F.col("id")).alias("id"), F.col("id").alias("tenant_id"),
        F.sha2(F.concat(F.lit("key_"), F.col("id")), 256).alias("key_hash"),
        F.lit("fixture key").alias("label"),
        F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_used_at"),
    )


# --------------------------------------------------------------------------- logs and commands

STATUSES = ["new", "reviewed", "planned", "done", "wontfix"]


def retrieval_logs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load_raw(spark, sf_dir, "events")
    return ev.select(
        F.concat(F.lit("r"), F.col("event_id")).alias("id"),
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"),
        F.concat(F.lit("u"), F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("search")).otherwise(F.lit("context"))
        .alias("endpoint"),
        (F.col("event_id") % 11).alias("result_count"),
        F.col("ts").alias("created_at"),
    )


def feedback_submissions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback posts from documents: type by doc_id % 4 (one in four is not
    a valid type), title the first 210 characters (100 when doc_id % 3 > 0),
    description the text, some without email, half with an API key."""
    d = load_raw(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("seq"),
        _pick(FEEDBACK_TYPES, "doc_id % 4").alias("type"),
        F.expr("substring(text, 1, CASE WHEN doc_id % 3 > 0 THEN 100 ELSE 210 END)").alias("title"),
        F.col("text").alias("description"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("d"), F.col("doc_id"), F.lit("@example.com"))).alias("email"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Bearer key_t"), F.col("doc_id") % 4))
        .alias("authorization"),
        F.expr(f"timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ'{EPOCH}')").alias("created_at"),
    )


def feedback_table_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feedback table: all documents, a valid type by doc_id % 3, status by
    doc_id % 5 and votes 1 + (doc_id * 37) % 50."""
    d = load_raw(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("f"), F.col("doc_id")).alias("id"),
        F.lit(None).cast("string").alias("tenant_id"),
        _pick(FEEDBACK_TYPES[:3], "doc_id % 3").alias("type"),
        F.substring("text", 1, 100).alias("title"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("email"),
        _pick(STATUSES, "doc_id % 5").alias("status"),
        (F.lit(1) + (F.col("doc_id") * 37) % 50).cast("bigint").alias("votes"),
        F.lit("{}").alias("metadata"),
        F.expr(f"timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ'{EPOCH}')").alias("created_at"),
    )


def votes_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = load_raw(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("vote_id"),
                     F.concat(F.lit("f"), F.col("event_id") % 300).alias("feedback_id"),
                     F.col("ts").alias("voted_at"))


def auth_requests_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header 'Bearer key_t<user_id % 4>' (t3 has no key); every 9th event
    without the prefix."""
    ev = load_raw(spark, sf_dir, "events")
    raw = F.concat(F.lit("key_t"), F.col("user_id") % 4)
    return ev.select(F.col("event_id").alias("request_id"),
                     F.when(F.col("event_id") % 9 == 0, raw).otherwise(F.concat(F.lit("Bearer "), raw))
                     .alias("authorization"),
                     F.col("ts"))


def signups_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups from customers: ip by c_custkey % 7, one every 97 s; emails
    fold c_custkey % 50 in mixed case and spacing; every 17th lacks '@';
    every 23rd reuses an existing tenant's email; some with a referrer."""
    c = load_raw(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 50
    email = (F.when(F.col("c_custkey") % 17 == 0, F.concat(F.lit("user"), k, F.lit("mail.com")))
             .when(F.col("c_custkey") % 23 == 0,
                   F.concat(F.lit("t"), F.col("c_custkey") % 3, F.lit("@example.com")))
             .when(F.col("c_custkey") % 6 == 0, F.concat(F.lit(" User"), k, F.lit("@Mail.COM ")))
             .when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("User"), k, F.lit("@Mail.COM")))
             .otherwise(F.concat(F.lit("user"), k, F.lit("@mail.com"))))
    return c.select(
        F.col("c_custkey").alias("seq"),
        F.concat(F.lit("ip"), F.col("c_custkey") % 7).alias("ip"),
        (F.lit(1704067200) + F.col("c_custkey") * 97).cast("bigint").alias("t"),
        email.alias("email"),
        F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("https://ref"), F.col("c_custkey") % 3,
                                                     F.lit(".example"))).alias("referrer"),
    )


def rate_events_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-limit input: key user_id % 3, t = ts in whole epoch seconds."""
    from engram.functions.scalars import epoch_seconds

    ev = load_raw(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("k"), F.col("user_id") % 3).alias("key"), epoch_seconds("ts").alias("t"),
                     "event_id")


# Price ids of the fixture's billing log and the plans they map to.
FIXTURE_PLANS = {"price_developer": ("developer", 200000), "price_pro": ("pro", 2000000)}


def billing_events_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing log from orders as JSON payloads: O -> checkout, F -> invoice
    paid, P -> subscription deleted; tenant = customer = o_custkey; price by
    priority (1-URGENT pro, 2-HIGH / 3-MEDIUM developer, else unknown).
    Checkouts lack a tenant when o_orderkey % 97 = 0, lack a customer when
    o_orderkey % 89 = 0 and claim the next customer when o_orderkey % 101 = 0."""
    o = load_raw(spark, sf_dir, "orders")
    typ = (F.when(F.col("o_orderstatus") == "O", F.lit("checkout.session.completed"))
           .when(F.col("o_orderstatus") == "F", F.lit("invoice.payment_succeeded"))
           .otherwise(F.lit("customer.subscription.deleted")))
    checkout = F.col("o_orderstatus") == "O"
    customer = (F.when(checkout & (F.col("o_orderkey") % 89 == 0), F.lit(None).cast("string"))
                .when(checkout & (F.col("o_orderkey") % 101 == 0),
                      F.concat(F.lit("cus_"), F.col("o_custkey") + 1))
                .otherwise(F.concat(F.lit("cus_"), F.col("o_custkey"))))
    tenant = F.when(checkout & (F.col("o_orderkey") % 97 != 0), F.concat(F.lit("tc"), F.col("o_custkey")))
    price = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("price_pro"))
             .when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), F.lit("price_developer"))
             .otherwise(F.lit("price_unknown")))
    obj = F.struct(
        customer.alias("customer"),
        F.concat(F.lit("sub_"), F.col("o_orderkey")).alias("subscription"),
        F.when(tenant.isNotNull(), F.create_map(F.lit("tenant_id"), tenant)).alias("metadata"),
        F.struct(F.array(F.struct(F.struct(price.alias("id")).alias("price"))).alias("data")).alias("items"))
    from engram.functions.scalars import epoch_seconds

    secs = epoch_seconds("o_orderdate")
    payload = F.to_json(F.struct(
        F.concat(F.lit("evt_"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("id"),
        typ.alias("type"), secs.alias("created"), F.struct(obj.alias("object")).alias("data")))
    return o.select(payload.alias("payload"))


def billing_tenants_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant per customer.  Every third is on the pro plan and holds
    customer cus_<c_custkey + 2> before the log, so it meets that customer's
    own tenant there."""
    c = load_raw(spark, sf_dir, "customer")
    linked = F.col("c_custkey") % 3 == 0
    return c.select(F.concat(F.lit("tc"), F.col("c_custkey")).alias("id"),
                    F.when(linked, F.lit("pro")).otherwise(F.lit("free")).alias("plan"),
                    F.when(linked, F.lit(2000000)).otherwise(F.lit(10000)).cast("bigint").alias("memory_limit"),
                    F.when(linked, F.concat(F.lit("cus_"), F.col("c_custkey") + 2)).alias("stripe_customer_id"))


def subscription_items_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3 items: each lineitem is an item of subscription sub_<orderkey>;
    price by l_linenumber % 3 (developer, pro, unknown)."""
    li = load_raw(spark, sf_dir, "lineitem")
    price = F.element_at(F.array(F.lit("price_developer"), F.lit("price_pro"), F.lit("price_unknown")),
                         (F.col("l_linenumber") % 3 + 1).cast("int"))
    return li.select(F.concat(F.lit("sub_"), F.col("l_orderkey")).alias("subscription"),
                     F.col("l_linenumber").alias("item"), price.alias("price"))


def team_cmds_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team commands from events (cmd_id = event_id): tenant t<user_id % 3>
    and its team, another tenant's team when event_id % 11 = 0; actor
    u<(event_id div 3) % 20>, target u<event_id % 20>; role by event_id % 4
    ('owner' is invalid), none when event_id % 5 = 0; name empty when
    event_id % 17 = 0; slug team-<event_id % 7>, invalid when % 13 = 0."""
    ev = load_raw(spark, sf_dir, "events")
    role = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).otherwise(
        _pick(["admin", "member", "read_only", "owner"], "event_id % 4"))
    return ev.select(
        F.col("event_id").alias("cmd_id"),
        F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"),
        F.concat(F.lit("team"), F.when(F.col("event_id") % 11 == 0, (F.col("user_id") + 1) % 3)
                 .otherwise(F.col("user_id") % 3)).alias("team_id"),
        F.concat(F.lit("u"), F.expr("(event_id div 3) % 20")).alias("actor"),
        F.concat(F.lit("u"), F.col("event_id") % 20).alias("target"),
        role.alias("role"),
        F.when(F.col("event_id") % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("Team "), F.col("event_id")))
        .alias("name"),
        F.when(F.col("event_id") % 13 == 0, F.lit("Bad Slug")).otherwise(
            F.concat(F.lit("team-"), F.col("event_id") % 7)).alias("slug"),
        F.when(F.col("event_id") % 19 == 0, F.lit("broken")).otherwise(
            F.concat(F.lit(" E"), F.col("event_id"), F.lit("@Example.com"))).alias("email"),
    )


def rename_teams_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams from customers: tenant w<(c_custkey div 12)>, slug s<c_custkey % 12>; and their
    one admin u<c_custkey> (``rename_admins_fx``)."""
    c = load_raw(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("tm"), F.col("c_custkey")).alias("id"), F.concat(F.lit("w"), F.expr("c_custkey div 12")).alias("tenant_id"),
        F.concat(F.lit("Team "), F.col("c_custkey")).alias("name"), F.concat(F.lit("s"), F.col("c_custkey") % 12).alias("slug"))


def rename_admins_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load_raw(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("tm"), F.col("c_custkey")).alias("team_id"), F.concat(F.lit("u"), F.col("c_custkey")).alias("user_id"),
                    F.lit("admin").alias("role"))


def rename_cmds_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames from orders, by the team's admin (another user when o_orderkey % 19 = 0): slug
    s<(o_orderkey div 4) % 16>, an own one when o_orderkey % 5 = 0, none when % 7 = 0; a
    name when % 3 = 0."""
    o = load_raw(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("cmd_id"), F.concat(F.lit("w"), F.expr("o_custkey div 12")).alias("tenant_id"),
        F.concat(F.lit("tm"), F.col("o_custkey")).alias("team_id"),
        F.when(k % 19 == 0, F.lit("nobody")).otherwise(F.concat(F.lit("u"), F.col("o_custkey"))).alias("user_id"),
        F.when(k % 3 == 0, F.concat(F.lit("Name "), k)).alias("name"),
        F.when(k % 7 > 0, F.when(k % 5 == 0, F.concat(F.lit("own-"), F.col("o_custkey"))).otherwise(
            F.concat(F.lit("s"), F.expr("(o_orderkey div 4) % 16")))).alias("slug"))


def invitations_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invitations from documents: team doc_id % 3, token tok<doc_id>,
    expiring (doc_id % 60) days after the epoch, accepted when % 7 = 0."""
    d = load_raw(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("inv"), F.col("doc_id")).alias("id"),
        F.concat(F.lit("team"), F.col("doc_id") % 3).alias("team_id"),
        F.concat(F.lit("d"), F.col("doc_id"), F.lit("@example.com")).alias("email"),
        _pick(ROLES, "doc_id % 3").alias("role"),
        F.concat(F.lit("tok"), F.col("doc_id")).alias("token"),
        F.expr(f"timestampadd(DAY, doc_id % 60, TIMESTAMP_NTZ'{EPOCH}')").alias("expires_at"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(EPOCH).cast("timestamp_ntz")).alias("accepted_at"),
        F.lit(EPOCH).cast("timestamp_ntz").alias("created_at"),
    )


def accepts_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accept requests from events: token tok<event_id % (docs + 50)> (some
    unknown), user u<user_id % 20>, email given on odd events."""
    ev = load_raw(spark, sf_dir, "events")
    n_docs = load_raw(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    return ev.select(
        F.col("event_id").alias("cmd_id"),
        F.concat(F.lit("tok"), F.col("event_id") % (n_docs + 50)).alias("token"),
        F.concat(F.lit("u"), F.col("user_id") % 20).alias("user_id"),
        F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("a"), F.col("event_id"), F.lit("@example.com")))
        .alias("email"),
    )


def memory_cmds_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete / patch commands from events: memory m<event_id % (n + 20)>
    (20 unknown ids), its tenant except every 7th event (wrong tenant);
    visibility by event_id % 5 (private, team, -, -, public = invalid) and
    importance by event_id % 4 (-, 0.25, 1.5 = invalid, 0.75)."""
    ev = load_raw(spark, sf_dir, "events")
    n = _embedding_count(load_raw(spark, sf_dir, "embeddings"))
    k = F.col("event_id") % (n + 20)
    vis = F.element_at(F.array(F.lit("private"), F.lit("team"), F.lit(None).cast("string"),
                               F.lit(None).cast("string"), F.lit("public")),
                       (F.col("event_id") % 5 + 1).cast("int"))
    imp = F.element_at(F.array(F.lit(None).cast("double"), F.lit(0.25), F.lit(1.5), F.lit(0.75)),
                       (F.col("event_id") % 4 + 1).cast("int"))
    return ev.select(
        F.col("event_id").alias("cmd_id"),
        F.concat(F.lit("t"), F.when(F.col("event_id") % 7 == 0, (k + 1) % 3).otherwise(k % 3)).alias("tenant_id"),
        F.concat(F.lit("m"), k).alias("memory_id"),
        vis.alias("visibility"), imp.alias("importance"))


TOOL_PREFIX = "mem"


def tool_calls_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls from events: function by event_id % 6 (five known, one
    unknown), every 10th without user_id, JSON body {name, arguments}."""
    ev = load_raw(spark, sf_dir, "events")
    names = [f"{TOOL_PREFIX}_{k}" for k in ("store_memory", "search_memories", "get_context",
                                            "delete_memory", "get_usage")] + ["other_tool"]
    args = F.struct(
        F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("u"), F.col("user_id") % 20)).alias("user_id"),
        F.concat(F.lit("fact "), F.col("event_id")).alias("fact"),
        F.when(F.col("event_id") % 3 == 0, F.lit(0.9)).alias("importance"),
        F.when(F.col("event_id") % 4 == 0, F.lit("cursor")).alias("source"),
        F.when(F.col("event_id") % 5 == 0, F.lit("work")).alias("namespace"),
        F.when(F.col("event_id") % 7 > 0, F.col("event_type")).alias("q"),
        F.when(F.col("event_id") % 8 > 0, (F.col("event_id") % 90).cast("bigint")).alias("limit"),
        F.when(F.col("event_id") % 9 > 0, (F.col("event_id") % 30).cast("bigint")).alias("top_n"),
        F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("m"), F.col("event_id") % 600)).alias("memory_id"))
    body = F.to_json(F.struct(_pick(names, "event_id % 6").alias("name"), args.alias("arguments")))
    return ev.select(F.col("event_id").alias("call_id"),
                     F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), body.alias("body"))


def tool_log_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls that act on one another, from events: function by event_id
    % 6 as in tool_calls_fx, every 13th without user_id, namespace 'work' when
    % 5 = 0, limits as there.  The vector is v_k + b v_((k+1) % n) for a memory
    k of the user's own scope, b by (event_id div 6) % 4 of 0.1, 0.25, 0.6, 0.
    Deletes name memory k, or (event_id div 6) % 3 = 1 the memory that the
    store call 3 + 6 * (event_id % 4) calls before has made.  Contexts have a
    query when (event_id div 6) % 2 = 0."""
    ev = load_raw(spark, sf_dir, "events")
    e = load_raw(spark, sf_dir, "embeddings").select("vec_id", as_double("embedding").alias("v1"))
    n = _embedding_count(load_raw(spark, sf_dir, "embeddings"))
    names = [f"{TOOL_PREFIX}_{k}" for k in ("store_memory", "search_memories", "get_context", "delete_memory", "get_usage")] + ["other_tool"]
    k = F.col("user_id") % 60 + 60 * (F.col("event_id") % F.floor(n / 60))
    kind, turn = F.col("event_id") % 6, F.expr("event_id div 6")
    target = F.when(turn % 3 == 1, F.concat(F.lit("c"), F.col("event_id") - 3 - 6 * (F.col("event_id") % 4))).otherwise(F.concat(F.lit("m"), k))
    args = F.struct(
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("u"), F.col("user_id") % 20)).alias("user_id"),
        F.concat(F.lit("fact "), F.col("event_id")).alias("fact"),
        F.when(F.col("event_id") % 4 == 0, F.lit(0.75)).alias("importance"),
        F.when((kind == 1) & (F.col("event_id") % 10 < 5), F.lit("default")).when((kind == 0) & (F.col("event_id") % 12 > 0), F.lit("default"))
        .alias("source"),
        F.when((F.col("event_id") % 5 == 0) & (kind != 1), F.lit("work")).alias("namespace"),
        F.when((kind == 1) | (turn % 2 == 0), F.col("event_type")).alias("q"),
        F.when(F.col("event_id") % 8 > 0, (F.col("event_id") % 90).cast("bigint")).alias("limit"),
        F.when(F.col("event_id") % 9 > 0, (F.col("event_id") % 30).cast("bigint")).alias("top_n"),
        F.when(kind == 3, target).alias("memory_id"))
    body = F.to_json(F.struct(_pick(names, "event_id % 6").alias("name"), args.alias("arguments")))
    b = F.element_at(F.array(*[F.lit(x) for x in ARRIVAL_MIX]), (turn % 4 + 1).cast("int"))
    calls = ev.select(F.col("event_id").alias("call_id"), F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"),
                      body.alias("body"), k.alias("k"), ((k + 1) % n).alias("j"), b.alias("b"))
    other = e.select(F.col("vec_id").alias("j"), F.col("v1").alias("v2"))
    return (calls.join(e.withColumnRenamed("vec_id", "k"), "k", "left").join(other, "j", "left")
            .select("call_id", "tenant_id", "body", F.zip_with("v1", "v2", lambda x, y: x + y * F.col("b")).alias("vector")))


def store_bodies_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store-memory request bodies from documents (JSON): the whole text as
    fact, importance (doc_id % 13) / 10 (some above 1), source and lang as
    source and namespace, visibility by doc_id % 5, a team id (not a uuid
    when doc_id % 12 = 0, uuid-shaped when % 12 = 6), an extra field, an
    empty user_id when doc_id % 29 = 0 and a truncated body when % 31 = 0."""
    d = load_raw(spark, sf_dir, "documents")
    vis = F.element_at(F.array(F.lit("private"), F.lit("team"), F.lit(None).cast("string"), F.lit("public"),
                               F.lit(None).cast("string")), (F.col("doc_id") % 5 + 1).cast("int"))
    team = (F.when(F.col("doc_id") % 12 == 0, F.concat(F.lit("team"), F.col("doc_id") % 3))
            .when(F.col("doc_id") % 12 == 6, F.concat(F.lit("00000000-0000-0000-0000-"),
                                                      F.lpad(F.col("doc_id").cast("string"), 12, "0"))))
    body = F.to_json(F.struct(
        F.when(F.col("doc_id") % 29 == 0, F.lit("")).otherwise(F.concat(F.lit("u"), F.col("doc_id") % 20))
        .alias("user_id"),
        F.col("text").alias("fact"),
        ((F.col("doc_id") % 13).cast("double") / F.lit(10.0)).alias("importance"),
        F.col("source").alias("source"), F.col("lang").alias("namespace"),
        vis.alias("visibility"), team.alias("team_id"), F.lit(1).alias("extra")))
    body = F.when(F.col("doc_id") % 31 == 0, F.expr("substring(to_json(named_struct('x', text)), 1, 20)")) \
        .otherwise(body)
    return d.select(F.col("doc_id").alias("seq"), body.alias("body"))


def vectors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A (text, embedding) table: memories' facts, first vec_id per
    trimmed text."""
    from pyspark.sql import Window

    m = memories_fx(spark, sf_dir).withColumn("i", F.expr("cast(substring(id, 2) as bigint)"))
    w = Window.partitionBy(F.trim("fact")).orderBy("i")
    return (m.filter(F.col("fact").isNotNull()).withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1)
            .select(F.col("id").alias("vector_id"), F.col("fact").alias("text"), "embedding"))


def edge_log_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory graph edge log from embeddings: m_i -> m_((7i + 3) % n) typed
    by i % 3; m_i -> m_((i + 1) % n) for i % 4 = 0; a second version of
    every fifth edge with a new weight."""
    e = load_raw(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"))
    n = _embedding_count(load_raw(spark, sf_dir, "embeddings"))
    types = ["relates", "supports", "contradicts"]
    a = e.select(F.concat(F.lit("m"), F.col("i")).alias("src"),
                 F.concat(F.lit("m"), (F.col("i") * 7 + 3) % n).alias("dst"),
                 _pick(types, "i % 3").alias("type"),
                 ((F.col("i") * 13) % 10).cast("double").alias("w"), F.col("i"))
    b = e.filter(F.col("i") % 4 == 0).select(
        F.concat(F.lit("m"), F.col("i")).alias("src"), F.concat(F.lit("m"), (F.col("i") + 1) % n).alias("dst"),
        F.lit("relates").alias("type"), ((F.col("i") * 3) % 10).cast("double").alias("w"), F.col("i"))
    base = a.unionByName(b)
    v1 = base.select("src", "dst", "type", (F.col("w") / F.lit(10.0)).alias("weight"), F.lit(1).alias("version"))
    v2 = base.filter(F.col("i") % 5 == 0).select(
        "src", "dst", "type", (((F.col("i") * 17) % 10).cast("double") / F.lit(10.0)).alias("weight"),
        F.lit(2).alias("version"))
    return v1.unionByName(v2)
