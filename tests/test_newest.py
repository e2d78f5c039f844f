"""R2 ranks a scope's rows once; reads at a place in the log go through tiles."""

from __future__ import annotations

from engram.operators import near
from engram.operators import retrieval as R


def test_few_rows_of_a_scope_meet_queries(spark):
    rows = spark.sql("""select concat('m', id) id, 't' tenant_id, concat('u', id % 2) user_id, 'n' namespace, if(id % 5 = 0, 'team', null) team_id,
        if(id % 10 = 0, 'team', 'private') visibility, 0.5D importance, timestampadd(minute, cast(id % 50 as int), timestamp_ntz'2024-01-01') created_at, 'api' source,
        cast(null as timestamp_ntz) valid_until from range(400)""")
    kept = {r["id"] for r in R.newest_of_scopes(rows, 3).collect()}
    all_rows = rows.collect()
    order = sorted(sorted(all_rows, key=lambda r: r["id"]), key=lambda r: r["created_at"], reverse=True)
    want = set()
    for user in ("u0", "u1"):
        mine = [r for r in order if r["user_id"] == user]
        want |= {r["id"] for r in mine[:6]} | {r["id"] for r in [r for r in mine if not r["team_id"]][:6]}
    want |= {r["id"] for r in [r for r in order if r["team_id"] and r["visibility"] == "team"][:6]}
    assert kept == want and len(kept) <= 30


def test_newest_living(spark):
    scope = ("t", "n", "u", "x")
    probes = [(f"q{k}", 10 * k, 1 + k % 4, *scope) for k in range(30)]
    rows = [(f"m{k}", 5 * k - 20, 5 * k + 60 if k % 4 else None, k % 6, *scope) for k in range(70)]
    names = "s1 string, s2 string, s3 string, s4 string"
    p = spark.createDataFrame(probes, f"src string, at bigint, k int, {names}")
    r = spark.createDataFrame(rows, f"dst string, born bigint, died bigint, newness bigint, {names}")
    age = {x[0]: (-x[3], x[0]) for x in rows}
    for tile in (8, 1000):
        found = {}
        for x in near.newest(p, r, tile).collect():
            found.setdefault(x["src"], []).append(age[x["dst"]])
        for src, at, k, *_ in probes:
            assert sorted(found.get(src, []))[:k] == sorted(age[x[0]] for x in rows if x[1] < at and (x[2] is None or x[2] > at))[:k]
