"""Accounts: authentication (J1, M9), signup (J6, U1), waitlist (U3),
feedback (C2, J9, FB1, FB2) and email checks (C4).

Every operator takes a batch of requests as a DataFrame and returns one
outcome row per request (HTTP-like status + reason), plus the rows it
would insert where that matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import scalars as S
from engram.operators.ingest import prior_count
from engram.operators.ratelimit import rate_limit
from engram.operators.retrieval import DEFAULT_BROADCAST_ROWS

BEARER = "Bearer "
FEEDBACK_TYPES = ("feature", "bug", "general")   # fixed: the accepted feedback types
TITLE_MAX, DESCRIPTION_MAX = 200, 5000


def bearer_key(header) -> "F.Column":
    """The raw key after 'Bearer ', or null when the prefix is missing."""
    h = S.col_(header)
    return F.when(h.startswith(BEARER), h.substr(F.lit(len(BEARER) + 1), F.length(h)))


def authenticate(requests: DataFrame, api_keys: DataFrame, tenants: DataFrame,
                 header: str = "authorization") -> DataFrame:
    """requests(request_id, authorization, ...) -> + status (200/401),
    reason, key_id, tenant_id, plan, memory_limit."""
    keys = (api_keys.select(F.col("id").alias("key_id"), F.col("tenant_id").alias("_k_tenant"), "key_hash")
            .join(tenants.select(F.col("id").alias("_k_tenant"), "plan", "memory_limit"), "_k_tenant"))
    r = requests.withColumn("_raw", bearer_key(header)).withColumn("_hash", S.key_hash("_raw"))
    j = r.join(keys, r["_hash"] == keys["key_hash"], "left")
    status = (F.when(F.col("_raw").isNull(), F.lit(401)).when(F.col("key_id").isNull(), F.lit(401))
              .otherwise(F.lit(200)))
    reason = (F.when(F.col("_raw").isNull(), F.lit("missing or invalid authorization header"))
              .when(F.col("key_id").isNull(), F.lit("invalid api key")))
    return (j.withColumn("status", status).withColumn("reason", reason)
            .withColumnRenamed("_k_tenant", "tenant_id")
            .drop("_raw", "_hash", "key_hash"))


def key_last_used(auth: DataFrame, api_keys: DataFrame, ts: str = "ts") -> DataFrame:
    """M9: api_keys with last_used_at = time of the last successful auth."""
    last = (auth.filter(F.col("status") == 200).groupBy("key_id")
            .agg(F.max(ts).alias("_last")))
    return (api_keys.join(last, api_keys["id"] == last["key_id"], "left")
            .select(api_keys["id"], "tenant_id", F.coalesce("_last", "last_used_at").alias("last_used_at")))


def valid_email(email) -> "F.Column":
    """C4: non-empty and contains '@' and '.'."""
    e = S.col_(email)
    return e.isNotNull() & (F.length(e) > 0) & e.contains("@") & e.contains(".")


# Fixed value: the email format of a request body (atoms, dots, host labels).
EMAIL_FORMAT = (r"(?i)^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
                r"@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z0-9]([a-z0-9-]*[a-z0-9])?\z")


def signup(signups: DataFrame, tenants: DataFrame, api_keys: DataFrame, n: int = 5,
           window_s: int = 3600) -> DataFrame:
    """U1 (+ U2 throttle, C4, J6): signups(seq, ip, t, email) in seq order.

    400 when the body's email is not in email format: such requests never
    reach the throttle.  Of the others, 429 when the ip is throttled; 400 for
    an invalid email; 409 when the email already has a tenant (with a key: J6 semi join; without: the
    unique index) or an earlier signup in the batch won; else 201 with the
    new tenant's name."""
    formed = F.coalesce(F.col("email").rlike(EMAIL_FORMAT), F.lit(False))
    throttled = rate_limit(signups.filter(formed).withColumnRenamed("ip", "key"), "key", "t", "seq", n, window_s)
    unformed = signups.filter(~formed).select("seq", "email", F.lit(False).alias("formed"), F.lit(True).alias("accepted"))
    s = throttled.select("seq", "email", F.lit(True).alias("formed"), "accepted").unionByName(unformed)
    s = s.withColumn("email_n", S.norm_email("email"))
    with_key = tenants.join(api_keys.select(F.col("tenant_id").alias("id")).distinct(), "id", "left_semi")
    taken = (tenants.filter(F.col("email").isNotNull())
             .select(F.col("email").alias("email_n"), F.lit(True).alias("_exists"))
             .join(with_key.select(F.col("email").alias("email_n"), F.lit(True).alias("_has_key")),
                   "email_n", "left").dropDuplicates(["email_n"]))
    s = s.join(taken, "email_n", "left")
    ok = F.col("formed") & F.col("accepted") & valid_email("email_n") & F.col("_exists").isNull()
    # an earlier signup of the same email that reached the insert step wins
    s = prior_count(s, ["email_n"], ["seq"], ok, "_prior_ok")
    status = (F.when(~F.col("formed"), F.lit(400)).when(~F.col("accepted"), F.lit(429))
              .when(~valid_email("email_n"), F.lit(400))
              .when(F.col("_exists").isNotNull(), F.lit(409))
              .when(F.coalesce(F.col("_prior_ok"), F.lit(0)) > 0, F.lit(409))
              .otherwise(F.lit(201)))
    reason = (F.when(status == 429, F.lit("too many signup attempts"))
              .when(status == 400, F.lit("invalid email"))
              .when(status == 409, F.lit("already_registered")))
    return s.select("seq", status.alias("status"), reason.alias("reason"),
                    F.col("email_n").alias("email"),
                    F.when(status == 201, S.name_from_email("email_n")).alias("tenant_name"))


def waitlist(signups: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """signups(seq, email, referrer) -> subscribed / already_signed_up /
    400 invalid.  First signup per normalised email wins."""
    s = signups.withColumn("email_n", S.norm_email("email"))
    valid = valid_email("email_n")
    if existing is not None:
        s = s.join(existing.select(F.col("email").alias("email_n"), F.lit(True).alias("_old")),
                   "email_n", "left")
    else:
        s = s.withColumn("_old", F.lit(None).cast("boolean"))
    s = prior_count(s, ["email_n"], ["seq"], valid, "_prior")
    first = valid & F.col("_old").isNull() & (F.coalesce("_prior", F.lit(0)) == 0)
    return s.select(
        "seq", F.when(valid, F.lit(200)).otherwise(F.lit(400)).alias("status_code"),
        F.when(~valid, F.lit("invalid email")).when(first, F.lit("subscribed"))
        .otherwise(F.lit("already_signed_up")).alias("status"),
        F.when(valid, F.col("email_n")).alias("email"),
        F.when(first, F.coalesce(F.col("referrer"), F.lit("direct"))).alias("source"))


def validate_feedback(df: DataFrame) -> DataFrame:
    """The first failing rule wins (type/title missing, type enum,
    title > 200, description > 5000)."""
    missing = F.col("type").isNull() | (F.col("type") == "") | F.col("title").isNull() | (F.col("title") == "")
    reason = (F.when(missing, F.lit("missing"))
              .when(~F.col("type").isin(*FEEDBACK_TYPES), F.lit("unknown type"))
              .when(F.length("title") > TITLE_MAX, F.lit("long title"))
              .when(F.coalesce(F.length("description"), F.lit(0)) > DESCRIPTION_MAX,
                    F.lit("long description")))
    return df.withColumn("reason", reason).withColumn(
        "status", F.when(F.col("reason").isNull(), F.lit(201)).otherwise(F.lit(400)))


def feedback_tenant(df: DataFrame, api_keys: DataFrame, header: str = "authorization",
                    broadcast_rows: int = DEFAULT_BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Optional tenant from a Bearer key; unknown key -> null tenant.

    The rows of a busy key, and those without one, never meet in a task: keys are
    broadcast behind a proven bound, and above it each is dealt to ``salts`` tasks."""
    keys = api_keys.select(F.col("key_hash").alias("_h"), F.col("tenant_id"))
    r = df.withColumn("_h", S.key_hash(bearer_key(header)))
    if keys.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return r.join(F.broadcast(keys), "_h", "left").drop("_h")
    r = r.withColumn("_salt", (F.monotonically_increasing_id() % salts).cast("int"))
    keys = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return r.join(keys, ["_h", "_salt"], "left").drop("_h", "_salt")


def submit_feedback(posts: DataFrame, api_keys: DataFrame) -> DataFrame:
    """FB1: C2 split, J9 tenant, empty description/email -> null, status
    new, votes 1, metadata '{}'."""
    v = feedback_tenant(validate_feedback(posts), api_keys)
    ok = F.col("status") == 201
    empty_null = lambda c: F.when(F.length(F.col(c)) > 0, F.col(c))
    return v.select(
        "seq", "status", "reason",
        F.when(ok, F.col("tenant_id")).alias("tenant_id"),
        F.when(ok, F.col("type")).alias("type"),
        F.when(ok, F.col("title")).alias("title"),
        F.when(ok, empty_null("description")).alias("description"),
        F.when(ok, empty_null("email")).alias("email"),
        F.when(ok, F.lit("new")).alias("feedback_status"),
        F.when(ok, F.lit(1)).cast("bigint").alias("votes"),
        F.when(ok, F.lit("{}")).alias("metadata"))


def roadmap(feedback: DataFrame, type_: str | None = None, status: str | None = None,
            limit=None) -> DataFrame:
    """FB2: optional type/status filters, votes desc then created_at desc,
    limit 50 by default (max 100).  A global top-k: Spark plans it as
    TakeOrderedAndProject (per-partition top-k, then merge)."""
    f = feedback
    if type_:
        f = f.filter(F.col("type") == type_)
    if status:
        f = f.filter(F.col("status") == status)
    lim = min(int(limit) if limit is not None else 50, 100)
    top = f.orderBy(F.col("votes").desc(), F.col("created_at").desc(), F.col("id")).limit(lim)
    return top.select("id", "type", "title", "description", "status", F.col("votes").cast("bigint"),
                      S.iso_ms("created_at").alias("created_at"))
