"""Registered billing queries (B1-B3, S4) with DuckDB oracles.

The oracle states the link rule directly (correlated "latest earlier
successful claimant" subqueries), unrolled over enough materialised rounds
to reach the fixpoint; the Spark side uses windows and iterates until
nothing changes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import billing as B
from engram.plans.registry import register
from engram.sources import fixtures as FX

ROUNDS = 16
_BEFORE = "({x}.ts < {y}.ts OR ({x}.ts = {y}.ts AND {x}.event_id < {y}.event_id))"

_BEV = """
    SELECT 'evt_' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS event_id,
           epoch_us(o_orderdate) // 1000000 AS ts,
           CASE o_orderstatus WHEN 'O' THEN 'checkout.session.completed'
                              WHEN 'F' THEN 'invoice.payment_succeeded'
                              ELSE 'customer.subscription.deleted' END AS type,
           CASE WHEN o_orderstatus = 'O' AND o_orderkey % 89 = 0 THEN NULL
                WHEN o_orderstatus = 'O' AND o_orderkey % 101 = 0 THEN 'cus_' || (o_custkey + 1)
                ELSE 'cus_' || o_custkey END AS customer,
           'sub_' || o_orderkey AS subscription,
           CASE WHEN o_orderstatus = 'O' AND o_orderkey % 97 <> 0 THEN 'tc' || o_custkey END AS tenant_id,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'price_pro'
                WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'price_developer'
                ELSE 'price_unknown' END AS price
    FROM orders"""


def _billing_ctes() -> list[str]:
    parts = [f"bev AS ({_BEV})",
             "plans AS (SELECT * FROM (VALUES ('price_developer', 'developer', 200000::BIGINT), "
             "('price_pro', 'pro', 2000000::BIGINT)) v(price, plan, memory_limit))",
             "r0 AS MATERIALIZED (SELECT event_id, ts, tenant_id, customer, true AS ok FROM bev "
             "WHERE type = 'checkout.session.completed' AND tenant_id IN (SELECT 'tc' || c_custkey FROM customer) "
             "AND customer IS NOT NULL UNION ALL SELECT 'link:tc' || c_custkey, (-4611686018427387904)::BIGINT, "
             "'tc' || c_custkey, 'cus_' || (c_custkey + 2), true FROM customer WHERE c_custkey % 3 = 0)"]
    for k in range(1, ROUNDS + 1):
        p = f"r{k - 1}"
        parts.append(f"""r{k} AS MATERIALIZED (
        SELECT a.event_id, a.ts, a.tenant_id, a.customer,
               NOT coalesce((
                   SELECT h.tenant_id <> a.tenant_id AND coalesce((
                       SELECT x.customer FROM {p} x
                       WHERE x.ok AND x.tenant_id = h.tenant_id AND {_BEFORE.format(x='x', y='a')}
                       ORDER BY x.ts DESC, x.event_id DESC LIMIT 1) = a.customer, false)
                   FROM {p} h
                   WHERE h.ok AND h.customer = a.customer AND {_BEFORE.format(x='h', y='a')}
                   ORDER BY h.ts DESC, h.event_id DESC LIMIT 1), false) AS ok
        FROM {p} a)""")
    parts.append(f"links AS (SELECT * FROM r{ROUNDS})")
    parts.append(f"""owners AS (
        SELECT e.event_id, c.cand AS owner
        FROM bev e, LATERAL (
            SELECT h.tenant_id AS cand FROM links h
            WHERE h.ok AND h.customer = e.customer AND {_BEFORE.format(x='h', y='e')}
            ORDER BY h.ts DESC, h.event_id DESC LIMIT 1) c
        WHERE e.type IN ('invoice.payment_succeeded', 'customer.subscription.deleted')
          AND (SELECT x.customer FROM links x
               WHERE x.ok AND x.tenant_id = c.cand AND {_BEFORE.format(x='x', y='e')}
               ORDER BY x.ts DESC, x.event_id DESC LIMIT 1) = e.customer)""")
    parts.append("""changes AS (
        SELECT CASE WHEN e.type = 'checkout.session.completed' THEN e.tenant_id ELSE o.owner END AS tenant_id,
               e.ts, e.event_id, e.type AS kind,
               CASE WHEN e.type = 'customer.subscription.deleted' THEN 'free' ELSE p.plan END AS plan,
               CASE WHEN e.type = 'customer.subscription.deleted' THEN 10000::BIGINT ELSE p.memory_limit END
                   AS memory_limit
        FROM bev e
        LEFT JOIN owners o USING (event_id)
        LEFT JOIN plans p USING (price)
        LEFT JOIN (SELECT event_id FROM links WHERE NOT ok) rj USING (event_id)
        WHERE CASE WHEN e.type = 'checkout.session.completed' THEN e.tenant_id ELSE o.owner END
              IN (SELECT 'tc' || c_custkey FROM customer)
          AND ((e.type = 'checkout.session.completed' AND rj.event_id IS NULL AND e.subscription IS NOT NULL
               AND e.tenant_id IS NOT NULL AND p.plan IS NOT NULL)
           OR (e.type = 'invoice.payment_succeeded' AND e.subscription IS NOT NULL AND o.owner IS NOT NULL
               AND p.plan IS NOT NULL)
           OR (e.type = 'customer.subscription.deleted' AND o.owner IS NOT NULL)))""")
    return parts


def _sql(body: str) -> str:
    return "WITH " + ",\n".join(_billing_ctes()) + "\n" + body


_PLAN_STATE_BODY = """
    SELECT 'tc' || c.c_custkey AS tenant_id,
           coalesce(lc.plan, CASE WHEN c_custkey % 3 = 0 THEN 'pro' ELSE 'free' END) AS plan,
           coalesce(lc.memory_limit, CASE WHEN c_custkey % 3 = 0 THEN 2000000 ELSE 10000 END)::BIGINT AS memory_limit,
           ll.customer AS stripe_customer_id
    FROM customer c
    LEFT JOIN (SELECT tenant_id, arg_max(plan, (ts, event_id)) AS plan,
                      arg_max(memory_limit, (ts, event_id)) AS memory_limit
               FROM changes GROUP BY tenant_id) lc ON lc.tenant_id = 'tc' || c.c_custkey
    LEFT JOIN (SELECT tenant_id, arg_max(customer, (ts, event_id)) AS customer FROM links WHERE ok
               GROUP BY tenant_id) ll ON ll.tenant_id = 'tc' || c.c_custkey"""


def _events(spark, sf_dir):
    return B.parse_events(FX.billing_events_fx(spark, sf_dir))


@register("plan_state", _sql(_PLAN_STATE_BODY))
def q_plan_state(spark, sf_dir):
    return B.plan_state(_events(spark, sf_dir), FX.billing_tenants_fx(spark, sf_dir),
                        B.plans_table(spark, FX.FIXTURE_PLANS))


@register("plan_history", _sql("""
    SELECT tenant_id, event_id, plan, memory_limit, kind, ts AS valid_from,
           lead(ts) OVER (PARTITION BY tenant_id ORDER BY ts, event_id) AS valid_to
    FROM changes"""))
def q_plan_history(spark, sf_dir):
    return B.plan_history(_events(spark, sf_dir), FX.billing_tenants_fx(spark, sf_dir),
                          B.plans_table(spark, FX.FIXTURE_PLANS))


@register("billing_parse", """
    SELECT 'evt_' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS event_id,
           CASE o_orderstatus WHEN 'O' THEN 'checkout.session.completed'
                              WHEN 'F' THEN 'invoice.payment_succeeded'
                              ELSE 'customer.subscription.deleted' END AS type,
           CASE WHEN o_orderstatus = 'O' AND o_orderkey % 97 <> 0 THEN 'tc' || o_custkey END AS tenant_id,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'price_pro'
                WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'price_developer'
                ELSE 'price_unknown' END AS price
    FROM orders""")
def q_billing_parse(spark, sf_dir):
    """JSON billing payloads -> typed events."""
    return _events(spark, sf_dir).select("event_id", "type", "tenant_id", "price")


@register("highest_plan", """
    SELECT 'sub_' || l_orderkey AS subscription,
           arg_max(p.plan, p.memory_limit) AS plan, max(p.memory_limit) AS memory_limit
    FROM lineitem l
    LEFT JOIN (VALUES ('price_developer', 'developer', 200000::BIGINT), ('price_pro', 'pro', 2000000::BIGINT))
         p(price, plan, memory_limit)
      ON p.price = (['price_developer', 'price_pro', 'price_unknown'])[l.l_linenumber % 3 + 1]
    GROUP BY l_orderkey""")
def q_highest_plan(spark, sf_dir):
    return B.highest_plan(FX.subscription_items_fx(spark, sf_dir), B.plans_table(spark, FX.FIXTURE_PLANS))
