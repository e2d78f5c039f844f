"""Tool calls in call order: reads see exactly the stores and deletes before them."""

from __future__ import annotations

import json

import pytest

from engram.operators.tool_exec import ToolRun
from engram.sources import fixtures as FX

MEMORY = ("id string, tenant_id string, user_id string, fact string, embedding array<double>, importance double, decay_score double, "
          "access_count bigint, last_accessed_at timestamp_ntz, valid_until timestamp_ntz, created_at timestamp_ntz, source string, "
          "namespace string, team_id string, visibility string")


def axis(k, j=None, x=0.0):
    v = [0.0] * 8
    v[k] = 1.0
    if j is not None:
        v[j] = x
    return v


def call(k, name, vec=None, tenant="t", **args):
    return (k, tenant, json.dumps({"name": f"mem_{name}", "arguments": args}), vec)


@pytest.fixture(scope="module")
def run(spark):
    near = axis(0, 1, 0.25)
    calls = [
        call(1, "get_usage"),
        call(2, "store_memory", axis(0), user_id="u", fact="first"),            # c2, replaces old (cosine 0.97)
        call(3, "search_memories", axis(0), user_id="u", q="x", namespace="openai"),
        call(4, "delete_memory", memory_id="c2"),
        call(5, "search_memories", axis(0), user_id="u", q="x", namespace="openai"),
        call(6, "store_memory", axis(0), user_id="u", fact="again"),            # c6, stored: c2 is gone
        call(7, "delete_memory", memory_id="c2"),                               # 404, gone
        call(8, "delete_memory", memory_id="c6", tenant="other"),               # 404, another tenant's
        call(9, "delete_memory", memory_id="c10"),                              # 404, not there yet
        call(10, "store_memory", axis(5), user_id="u", fact="alone"),           # no neighbours
        call(11, "delete_memory", memory_id="c10"),                             # 204 without a fold
        call(12, "get_context", None, user_id="u"),
        call(13, "store_memory", axis(0, 1, 0.05), user_id="u", fact="copy"),   # duplicate of c6
        call(14, "get_usage"),
        call(15, "get_usage", tenant="other"),
        call(16, "store_memory", axis(3), user_id="u"),                         # 400
        call(17, "delete_memory", memory_id="kept"),
        call(18, "delete_memory", memory_id="kept"),
    ]
    base = (1.0, 1.0, 0, None, None, None, "api", "default", None, "private")
    rows = [("old", "t", "u", "old", near, *base), ("kept", "t", "u", "kept", axis(7), *base), ("dead", "t", "u", "dead", axis(6), *base)]
    mem = spark.createDataFrame(rows, MEMORY).selectExpr(
        "* except (valid_until, created_at)", "case when id = 'dead' then timestamp_ntz'2024-01-02' end valid_until", "timestamp_ntz'2024-01-01' created_at")
    frame = spark.createDataFrame(calls, "call_id long, tenant_id string, body string, vector array<double>")
    return ToolRun(frame, mem, FX.as_of_col(), "mem")


def test_stores_and_deletes(run):
    assert {r["call_id"]: (r["action"], r["memory_id"], r["replaced_id"]) for r in run.stored().collect()} == {
        2: ("replaced", "c2", "old"), 6: ("stored", "c6", None), 10: ("stored", "c10", None), 13: ("duplicate", "c6", None)}
    assert {r["call_id"]: r["status"] for r in run.delete_results().collect()} == {4: 204, 7: 404, 8: 404, 9: 404, 11: 204, 17: 204, 18: 404}


def test_reads_see_their_place(run):
    found = {}
    for r in run.search_results().collect():
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found == {3: ["c2"]}  # the search's namespace argument filters the source
    context = {r["query_id"]: (r["n_memories"], r["context"]) for r in run.context_results().collect()}
    assert context[12][0] == 2 and "again" in context[12][1] and "kept" in context[12][1] and "alone" not in context[12][1]


def test_usage_and_snapshot(spark, run):
    tenants = spark.createDataFrame([("t", "pro", 50)], "id string, plan string, memory_limit bigint")
    assert {r["call_id"]: (r["plan"], r["memory_limit"], r["memories_used"], r["memories_remaining"]) for r in run.usage_results(tenants).collect()} == {
        1: ("pro", 50, 2, 48), 14: ("pro", 50, 2, 48), 15: ("free", 10000, 0, 10000)}
    assert {r["id"] for r in run.snapshot().filter("valid_until is null").collect()} == {"c6"}
