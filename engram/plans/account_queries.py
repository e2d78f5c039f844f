"""Registered account queries: auth, signup, rate limit, waitlist, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import scalars as S
from engram.operators import accounts as A
from engram.operators.ratelimit import rate_limit
from engram.plans.oracle_fixtures import with_fixtures
from engram.plans.registry import register
from engram.sources import fixtures as FX

TS_US_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_US_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def rate_sql(src: str, key: str, t: str, tie: str, n: int = 5, window_s: int = 3600) -> dict[str, str]:
    """The serial rule as a recursive CTE (one step per event and key)."""
    return {
        "rl_ev": f"""SELECT {key} AS key, {t} AS t, {tie} AS tie,
                            row_number() OVER (PARTITION BY {key} ORDER BY {t}, {tie}) - 1 AS idx
                     FROM {src}""",
        "rl": f"""
            SELECT key, idx, t, tie, t + {window_s} AS reset, 1 AS cnt, true AS accepted, t AS window_start
            FROM rl_ev WHERE idx = 0
            UNION ALL
            SELECT e.key, e.idx, e.t, e.tie,
                   CASE WHEN e.t > r.reset THEN e.t + {window_s} ELSE r.reset END,
                   CASE WHEN e.t > r.reset THEN 1 WHEN r.cnt >= {n} THEN r.cnt ELSE r.cnt + 1 END,
                   CASE WHEN e.t > r.reset THEN true WHEN r.cnt >= {n} THEN false ELSE true END,
                   CASE WHEN e.t > r.reset THEN e.t ELSE r.window_start END
            FROM rl r JOIN rl_ev e ON e.key = r.key AND e.idx = r.idx + 1""",
    }


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _keys_tenants(spark, sf_dir):
    return FX.api_keys_fx(spark, sf_dir), FX.tenants_fx(spark, sf_dir)


_AUTH_CTES = {
    "keys": """SELECT a.id, a.tenant_id, a.key_hash, t.plan, t.memory_limit
               FROM api_keys_fx a JOIN tenants_fx t ON t.id = a.tenant_id""",
    "auth": """
        SELECT r.request_id, r.ts,
               CASE WHEN NOT starts_with(r.authorization, 'Bearer ') THEN 401
                    WHEN k.id IS NULL THEN 401 ELSE 200 END AS status,
               CASE WHEN NOT starts_with(r.authorization, 'Bearer ')
                    THEN 'missing or invalid authorization header'
                    WHEN k.id IS NULL THEN 'invalid api key' END AS reason,
               k.id AS key_id, k.tenant_id, k.plan, k.memory_limit
        FROM auth_requests_fx r LEFT JOIN keys k
          ON starts_with(r.authorization, 'Bearer ') AND k.key_hash = sha256(substring(r.authorization, 8))""",
}


@register("auth_requests", with_fixtures("""
    SELECT request_id, status, reason, key_id, tenant_id, plan, memory_limit FROM auth""",
    "auth_requests_fx", "api_keys_fx", "tenants_fx", extra=_AUTH_CTES))
def q_auth(spark, sf_dir):
    keys, tenants = _keys_tenants(spark, sf_dir)
    a = A.authenticate(FX.auth_requests_fx(spark, sf_dir), keys, tenants)
    return a.select("request_id", "status", "reason", "key_id", "tenant_id", "plan", "memory_limit")


@register("key_last_used", with_fixtures(f"""
    SELECT a.id, a.tenant_id, {TS_US_SQL.format(c='coalesce(l.last, a.last_used_at)')} AS last_used_at
    FROM api_keys_fx a LEFT JOIN (SELECT key_id, max(ts) AS last FROM auth WHERE status = 200
                                  GROUP BY key_id) l ON l.key_id = a.id""",
    "auth_requests_fx", "api_keys_fx", "tenants_fx", extra=_AUTH_CTES))
def q_key_last_used(spark, sf_dir):
    keys, tenants = _keys_tenants(spark, sf_dir)
    a = A.authenticate(FX.auth_requests_fx(spark, sf_dir), keys, tenants)
    k = A.key_last_used(a, keys)
    return k.select("id", "tenant_id", F.date_format("last_used_at", TS_US_SPARK).alias("last_used_at"))


@register("key_hash", with_fixtures("""
    SELECT r.request_id, sha256(substring(r.authorization, 8)) AS key_hash
    FROM auth_requests_fx r WHERE starts_with(r.authorization, 'Bearer ')""", "auth_requests_fx"))
def q_key_hash(spark, sf_dir):
    r = FX.auth_requests_fx(spark, sf_dir)
    return (r.withColumn("raw", A.bearer_key("authorization")).filter(F.col("raw").isNotNull())
            .select("request_id", S.key_hash("raw").alias("key_hash")))


@register("rate_limit", _recursive(with_fixtures("""
    SELECT key, tie AS event_id, t, accepted, window_start FROM rl""",
    "rate_events_fx", extra=rate_sql("rate_events_fx", "key", "t", "event_id"))))
def q_rate_limit(spark, sf_dir):
    r = rate_limit(FX.rate_events_fx(spark, sf_dir), "key", "t", "event_id", 5, 3600)
    return r.select("key", "event_id", "t", "accepted", "window_start")


_FORMED = "coalesce(regexp_matches(email, '" + A.EMAIL_FORMAT.replace("'", "''") + "'), false)"
_SIGNUP_CTES = {
    "formed": f"SELECT * FROM signups_fx WHERE {_FORMED}",
    **rate_sql("formed", "ip", "t", "seq"),
    "taken": """
        SELECT t.email FROM tenants_fx t WHERE t.email IS NOT NULL GROUP BY t.email""",
    "s": f"""
        SELECT f.seq, lower(trim(f.email)) AS email_n, coalesce(rl.accepted, false) AS accepted, {_FORMED} AS formed,
               lower(trim(f.email)) IN (SELECT email FROM taken) AS exists_
        FROM signups_fx f LEFT JOIN rl ON rl.key = f.ip AND rl.tie = f.seq""",
    "s2": """
        SELECT *, (length(email_n) > 0 AND contains(email_n, '@') AND contains(email_n, '.')) AS valid
        FROM s""",
    "s3": """
        SELECT *, sum(CASE WHEN accepted AND valid AND NOT exists_ THEN 1 ELSE 0 END)
                  OVER (PARTITION BY email_n ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                  AS prior_ok
        FROM s2""",
    "s4": """
        SELECT seq, email_n,
               CASE WHEN NOT formed THEN 400 WHEN NOT accepted THEN 429 WHEN NOT valid THEN 400 WHEN exists_ THEN 409
                    WHEN coalesce(prior_ok, 0) > 0 THEN 409 ELSE 201 END AS status
        FROM s3""",
}


@register("signup", _recursive(with_fixtures("""
    SELECT seq, status,
           CASE status WHEN 429 THEN 'too many signup attempts' WHEN 400 THEN 'invalid email'
                       WHEN 409 THEN 'already_registered' END AS reason,
           email_n AS email,
           CASE WHEN status = 201 THEN split_part(email_n, '@', 1) END AS tenant_name
    FROM s4""", "signups_fx", "tenants_fx", extra=_SIGNUP_CTES)))
def q_signup(spark, sf_dir):
    keys, tenants = _keys_tenants(spark, sf_dir)
    return A.signup(FX.signups_fx(spark, sf_dir), tenants, keys)


@register("signup_conflicts", with_fixtures("""
    SELECT f.seq, lower(trim(f.email)) AS email
    FROM signups_fx f
    WHERE lower(trim(f.email)) IN (SELECT t.email FROM tenants_fx t JOIN api_keys_fx a ON a.tenant_id = t.id)""",
    "signups_fx", "tenants_fx", "api_keys_fx"))
def q_signup_conflicts(spark, sf_dir):
    """Signups whose normalised email already belongs to a tenant that
    has a key (semi join)."""
    keys, tenants = _keys_tenants(spark, sf_dir)
    with_key = tenants.join(keys.select(F.col("tenant_id").alias("id")), "id", "left_semi")
    s = FX.signups_fx(spark, sf_dir).withColumn("email", S.norm_email("email"))
    return s.join(with_key.select("email"), "email", "left_semi").select("seq", "email")


@register("validate_email", with_fixtures("""
    SELECT seq, lower(trim(email)) AS email,
           (length(lower(trim(email))) > 0 AND contains(lower(trim(email)), '@')
            AND contains(lower(trim(email)), '.')) AS valid
    FROM signups_fx""", "signups_fx"))
def q_validate_email(spark, sf_dir):
    s = FX.signups_fx(spark, sf_dir).select("seq", S.norm_email("email").alias("email"))
    return s.withColumn("valid", A.valid_email("email"))


@register("norm_email", with_fixtures("""
    SELECT seq, lower(trim(email)) AS email, split_part(lower(trim(email)), '@', 1) AS name
    FROM signups_fx""", "signups_fx"))
def q_norm_email(spark, sf_dir):
    s = FX.signups_fx(spark, sf_dir)
    return s.select("seq", S.norm_email("email").alias("email"),
                    S.name_from_email(S.norm_email("email")).alias("name"))


@register("waitlist", with_fixtures("""
    SELECT seq, CASE WHEN valid THEN 200 ELSE 400 END AS status_code,
           CASE WHEN NOT valid THEN 'invalid email' WHEN coalesce(prior, 0) = 0 THEN 'subscribed'
                ELSE 'already_signed_up' END AS status,
           CASE WHEN valid THEN email_n END AS email,
           CASE WHEN valid AND coalesce(prior, 0) = 0 THEN coalesce(referrer, 'direct') END AS source
    FROM (
        SELECT *, sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (
                    PARTITION BY email_n ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
        FROM (SELECT seq, referrer, lower(trim(email)) AS email_n,
                     (length(lower(trim(email))) > 0 AND contains(lower(trim(email)), '@')
                      AND contains(lower(trim(email)), '.')) AS valid
              FROM signups_fx))""", "signups_fx"))
def q_waitlist(spark, sf_dir):
    return A.waitlist(FX.signups_fx(spark, sf_dir))


_FB_REASON_SQL = """
    CASE WHEN type IS NULL OR type = '' OR title IS NULL OR title = '' THEN 'missing'
         WHEN type NOT IN ('feature', 'bug', 'general') THEN 'unknown type'
         WHEN length(title) > 200 THEN 'long title'
         WHEN coalesce(length(description), 0) > 5000 THEN 'long description'
    END"""


@register("validate_feedback", with_fixtures(f"""
    SELECT seq, CASE WHEN reason IS NULL THEN 201 ELSE 400 END AS status, reason
    FROM (SELECT seq, {_FB_REASON_SQL} AS reason FROM feedback_submissions_fx)""",
    "feedback_submissions_fx"))
def q_validate_feedback(spark, sf_dir):
    return A.validate_feedback(FX.feedback_submissions_fx(spark, sf_dir)).select("seq", "status", "reason")


_FB_TENANT_SQL = """
    SELECT f.*, k.tenant_id FROM feedback_submissions_fx f
    LEFT JOIN api_keys_fx k ON starts_with(f.authorization, 'Bearer ')
                           AND k.key_hash = sha256(substring(f.authorization, 8))"""


@register("feedback_tenant", with_fixtures("SELECT seq, tenant_id FROM ft", "feedback_submissions_fx",
                                           "api_keys_fx", "tenants_fx", extra={"ft": _FB_TENANT_SQL}))
def q_feedback_tenant(spark, sf_dir):
    keys, _ = _keys_tenants(spark, sf_dir)
    return A.feedback_tenant(FX.feedback_submissions_fx(spark, sf_dir), keys).select("seq", "tenant_id")


@register("submit_feedback", with_fixtures(f"""
    SELECT seq, status, reason,
           CASE WHEN ok THEN tenant_id END AS tenant_id, CASE WHEN ok THEN type END AS type,
           CASE WHEN ok THEN title END AS title,
           CASE WHEN ok AND length(description) > 0 THEN description END AS description,
           CASE WHEN ok AND length(email) > 0 THEN email END AS email,
           CASE WHEN ok THEN 'new' END AS feedback_status,
           CASE WHEN ok THEN 1 END::BIGINT AS votes,
           CASE WHEN ok THEN '{{}}' END AS metadata
    FROM (SELECT *, CASE WHEN reason IS NULL THEN 201 ELSE 400 END AS status, reason IS NULL AS ok
          FROM (SELECT ft.*, {_FB_REASON_SQL} AS reason FROM ft))""",
    "feedback_submissions_fx", "api_keys_fx", "tenants_fx", extra={"ft": _FB_TENANT_SQL}))
def q_submit_feedback(spark, sf_dir):
    keys, _ = _keys_tenants(spark, sf_dir)
    return A.submit_feedback(FX.feedback_submissions_fx(spark, sf_dir), keys)


_ROADMAP_SQL = """
    SELECT id, type, title, description, status, votes,
           strftime(created_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at
    FROM feedback_table_fx {where}
    ORDER BY votes DESC, created_at DESC, id LIMIT {limit}"""


@register("roadmap", with_fixtures(_ROADMAP_SQL.format(where="", limit=50), "feedback_table_fx"))
def q_roadmap(spark, sf_dir):
    return A.roadmap(FX.feedback_table_fx(spark, sf_dir))


@register("roadmap_filtered", with_fixtures(
    _ROADMAP_SQL.format(where="WHERE type = 'bug' AND status = 'new'", limit=100), "feedback_table_fx"))
def q_roadmap_filtered(spark, sf_dir):
    return A.roadmap(FX.feedback_table_fx(spark, sf_dir), "bug", "new", 500)
