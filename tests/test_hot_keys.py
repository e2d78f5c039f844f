"""Joins by a few values: no share of the big side goes to one task."""

from __future__ import annotations

from engram.operators import accounts as A
from engram.operators import billing as B


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feedback_tenant_spreads_posts(spark):
    posts = [(k, f"Bearer key_{k % 3}" if k % 2 else None) for k in range(60)] + [(99, "key_1"), (100, "Bearer key_9")]
    posts = spark.createDataFrame(posts, "seq long, authorization string")
    keys = spark.sql("select sha2('key_' || id, 256) key_hash, 't' || id tenant_id from range(3)")
    want = {r["seq"]: f"t{r['seq'] % 3}" if r["seq"] % 2 and r["seq"] < 60 else None for r in posts.collect()}
    for few in (A.feedback_tenant(posts, keys), A.feedback_tenant(posts, keys, broadcast_rows=2, salts=5)):
        rows = few.collect()
        assert {r["seq"]: r["tenant_id"] for r in rows} == want and len(rows) == 62
        assert few.columns == ["seq", "authorization", "tenant_id"]
    assert "BroadcastHashJoin" in _plan(A.feedback_tenant(posts, keys))
    assert "_salt" in _plan(A.feedback_tenant(posts, keys, broadcast_rows=2))


def test_highest_plan_aggregates_by_hash(spark):
    plans = B.plans_table(spark, {"p1": ("developer", 200), "p2": ("pro", 2000)})
    items = spark.createDataFrame([("a", "p1"), ("a", "p2"), ("a", "x"), ("b", "p1"), ("c", "x"), ("d", None)], "subscription string, price string")
    got = B.highest_plan(items, plans)
    assert {tuple(r) for r in got.collect()} == {("a", "pro", 2000), ("b", "developer", 200), ("c", None, None), ("d", None, None)}
    assert "SortAggregate(key=[subscription" not in _plan(got) and "SortMergeJoin" not in _plan(got)


def test_prices_are_broadcast(spark):
    events = spark.createDataFrame([], "event_id string, type string, ts bigint, customer string, subscription string, tenant_id string, price string, rejected boolean")
    tenants = spark.createDataFrame([], "id string, stripe_customer_id string")
    links = spark.createDataFrame([], "event_id string, ts bigint, tenant_id string, customer string, ok boolean")
    plan = _plan(B.effective_changes(events, tenants, B.plans_table(spark, {"p1": ("pro", 2000)}), links))
    assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "price" in x]
