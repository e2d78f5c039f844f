"""Links that exist before the billing log, and long chains of claims."""

from __future__ import annotations

from engram.operators import billing as B

EVENTS = "event_id string, type string, ts bigint, customer string, subscription string, tenant_id string, price string, rejected boolean"
TENANTS = "id string, plan string, memory_limit bigint, stripe_customer_id string"


def _plans(spark):
    return B.plans_table(spark, {"p": ("pro", 2000000)})


def test_links_before_the_log(spark):
    tenants = spark.createDataFrame([("t1", "pro", 2000000, "cus_1"), ("t2", "free", 10000, "cus_2"),
                                     ("t3", "free", 10000, None)], TENANTS)
    events = spark.createDataFrame([
        ("e1", B.DELETED, 1, "cus_1", None, None, None, False),
        ("e2", B.INVOICE, 2, "cus_2", "s2", None, "p", False),
        ("e3", B.CHECKOUT, 3, "cus_1", "s3", "t3", "p", False),  # t1 holds cus_1: the whole event fails
        ("e4", B.CHECKOUT, 4, "cus_9", "s4", "nobody", "p", False),  # no such tenant
        ("e5", B.INVOICE, 5, "cus_9", "s4", None, "p", False),
    ], EVENTS)
    got = {r["tenant_id"]: (r["plan"], r["stripe_customer_id"])
           for r in B.plan_state(events, tenants, _plans(spark)).collect()}
    assert got == {"t1": ("free", "cus_1"), "t2": ("pro", "cus_2"), "t3": ("free", None)}
    history = B.plan_history(events, tenants, _plans(spark)).collect()
    assert sorted((r["tenant_id"], r["event_id"]) for r in history) == [("t1", "e1"), ("t2", "e2")]


def test_chain_of_claims_longer_than_any_cap(spark):
    """Tenant i claims the customer of tenant i - 1, who never gets away: each
    outcome hangs on the one before, and all fail."""
    n = 70
    tenants = spark.createDataFrame([(f"t{i:03}", "free", 10000, f"cus_{i}") for i in range(n)], TENANTS)
    events = spark.createDataFrame([(f"e{i:03}", B.CHECKOUT, i, f"cus_{i - 1}", None, f"t{i:03}", None, False)
                                    for i in range(1, n)], EVENTS)
    links = B.link_outcomes(events, tenants)
    assert links.filter("ok and ts > 0").count() == 0
    assert links.filter("not ok").count() == n - 1
