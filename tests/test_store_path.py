"""The composed store path: every branch is reached, in-batch replacements close, and a
rewrite touches only the tenants that changed."""

from __future__ import annotations

import os
import tempfile

from conftest import SF_SMALL
from engram.operators import ingest as I
from engram.operators import store_path as P
from engram.plans.store_queries import TEAM_PATTERN
from engram.sources import fixtures as FX
from engram.sources.tables import write_snapshot

MEMORY = ("id string, tenant_id string, user_id string, fact string, embedding array<double>, importance double, decay_score double, "
          "access_count bigint, last_accessed_at timestamp_ntz, valid_until timestamp_ntz, created_at timestamp_ntz, source string, "
          "namespace string, team_id string, visibility string")
REQUEST = ("arrival_id string, arrival_order bigint, via string, tenant_id string, user_id string, namespace string, team_id string, "
           "visibility string, fact string, embedding array<double>, importance double, source string")
TEAMS = ("id string, tenant_id string", "team_id string, user_id string, role string")


def request(k, vec, tenant="t", via="api", **more):
    row = dict(arrival_id=f"r{k:02d}", arrival_order=k, via=via, tenant_id=tenant, user_id="u", namespace=None, team_id=None,
               visibility=None, fact="f", embedding=vec, importance=None, source=None)
    return tuple((row | more).values())


def run(spark, requests, limits, memories=()):
    mem = spark.createDataFrame(list(memories), MEMORY)
    teams = spark.createDataFrame([("team1", "t")], TEAMS[0])
    members = spark.createDataFrame([("team1", "u", "member"), ("team1", "ro", "read_only")], TEAMS[1])
    out, ok = P.store_requests(spark.createDataFrame(requests, REQUEST), mem,
                               spark.createDataFrame(limits, "id string, memory_limit bigint"), members, teams, TEAM_PATTERN)
    snap = P.next_snapshot(mem, ok, out, FX.as_of_col())
    return {r["arrival_id"]: r for r in out.collect()}, {r["id"]: r for r in snap.collect()}


def axis(k, *more):
    v = [0.0] * 16
    v[k] = 1.0
    for j, x in more:
        v[j] = x
    return v


def test_fixture_reaches_every_branch(spark):
    out, ok = P.store_requests(
        FX.store_requests_fx(spark, SF_SMALL), FX.memories_fx(spark, SF_SMALL), FX.store_tenants_fx(spark, SF_SMALL),
        FX.team_members_fx(spark, SF_SMALL), FX.teams_fx(spark, SF_SMALL), TEAM_PATTERN)
    rows = out.collect()
    assert {r["status"] for r in rows} == {200, 201, 400, 402, 403}
    assert {r["action"] for r in rows} == {"stored", "replaced", "duplicate", "refused", "rejected"}
    inside = {r["arrival_id"] for r in rows}
    assert any(r["replaced_id"] in inside for r in rows if r["action"] == "replaced")
    cut = {}
    for r in sorted(rows, key=lambda r: (r["arrival_order"], r["arrival_id"])):
        if r["action"] == "refused":
            cut.setdefault(r["tenant_id"], r["arrival_order"])
    assert any(r["action"] == "stored" and r["arrival_order"] > cut.get(r["tenant_id"], 10**9) for r in rows)  # tools go on


def test_replaced_in_the_batch_is_closed(spark):
    """The second arrival replaces the first, the third is a duplicate of the second."""
    near = axis(0, (1, 0.25))
    out, snap = run(spark, [request(1, axis(0)), request(2, near), request(3, near)], [])
    assert [out[k]["action"] for k in ("r01", "r02", "r03")] == ["stored", "replaced", "duplicate"]
    assert out["r02"]["replaced_id"] == "r01" and out["r03"]["memory_id"] == "r02"
    assert snap["r01"]["valid_until"] is not None and snap["r02"]["valid_until"] is None and "r03" not in snap


def test_refused_rows_are_unseen_by_later_tool_stores(spark):
    """Limit 2: the third api store is refused, so the tool store near it is new, and the
    tool store after that is a duplicate of the tool's row."""
    rows = [request(1, axis(0)), request(2, axis(1)), request(3, axis(2)), request(4, axis(2, (3, 0.25)), via="tool"),
            request(5, axis(2, (3, 0.25)), via="tool"), request(6, axis(0)), request(7, axis(0), tenant="other")]
    out, snap = run(spark, rows, [("t", 2)])
    assert [(out[f"r0{k}"]["status"], out[f"r0{k}"]["action"], out[f"r0{k}"]["count_before"]) for k in range(1, 8)] == [
        (201, "stored", 0), (201, "stored", 1), (402, "refused", 2), (201, "stored", 2), (201, "duplicate", 3), (402, "refused", 3),
        (201, "stored", 0)]
    assert out["r05"]["memory_id"] == "r04"
    assert sorted(snap) == ["r01", "r02", "r04", "r07"]
    assert (snap["r04"]["source"], snap["r01"]["source"]) == ("openai", "api")


def test_gates_and_visibility(spark):
    rows = [request(1, axis(0), team_id="team1", visibility="private"), request(2, axis(1), team_id="team1", user_id="ro"),
            request(3, axis(2), team_id="team1", user_id="nobody"), request(4, axis(3), importance=1.5), request(5, axis(4), fact=""),
            request(6, axis(5), team_id="not a team"), request(7, axis(6), via="tool", user_id=None), request(8, axis(7), visibility="team"),
            request(9, axis(8), via="tool", importance=1.5, visibility="team", team_id="team1"), request(10, axis(9))]
    out, snap = run(spark, rows, [("t", None)])
    assert [out[f"r{k:02d}"]["status"] for k in range(1, 11)] == [201, 403, 403, 400, 400, 400, 400, 201, 201, 201]
    assert {k: (r["visibility"], r["team_id"]) for k, r in snap.items()} == {
        "r01": ("team", "team1"), "r08": ("team", None), "r09": ("private", None), "r10": ("private", None)}


def test_only_changed_tenants_are_rewritten(spark):
    root = tempfile.mkdtemp(prefix="engram-s5-") + "/snap"
    memories = FX.memories_fx(spark, SF_SMALL)
    write_snapshot(memories, root)

    def files():
        return {t: sorted((f, os.stat(f"{root}/{t}/{f}").st_mtime_ns) for f in os.listdir(f"{root}/{t}")) for t in os.listdir(root) if "=" in t}

    before = files()
    arrivals = FX.arrivals_fx(spark, SF_SMALL).checkpoint().filter("tenant_id = 't1'")
    out = I.store(arrivals, memories).checkpoint()
    P.write_touched(memories, I.apply_outcomes(memories, arrivals, out, FX.as_of_col()), out, root)
    after = files()
    assert set(after) == set(before) == {"tenant_id=t0", "tenant_id=t1", "tenant_id=t2"}
    assert after["tenant_id=t0"] == before["tenant_id=t0"] and after["tenant_id=t2"] == before["tenant_id=t2"]
    assert after["tenant_id=t1"] != before["tenant_id=t1"]
    assert spark.read.parquet(root).count() == memories.count() + out.filter("action <> 'duplicate'").count()
