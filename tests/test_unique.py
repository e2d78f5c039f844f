"""Unique keys under claims and releases."""

from __future__ import annotations

import random

from engram.operators.teams import update_teams
from engram.operators.unique import claim_keys


def serial(claims, holders):
    holder = {(s, k): o for s, o, k in holders}
    held = {(s, o): k for s, o, k in holders}
    out = {}
    for cmd, s, o, k in sorted(claims):
        by = holder.get((s, k))
        out[cmd] = by in (None, o)
        if by is None:
            holder.pop((s, held.get((s, o))), None)
            held[s, o], holder[s, k] = k, o
    return out


def test_claims_against_a_walk(spark):
    rng = random.Random(2)
    holders = [(f"s{t}", f"o{i}", f"k{i}") for t in range(3) for i in range(6)]
    claims = [(i, f"s{rng.randrange(4)}", f"o{rng.randrange(8)}", f"k{rng.randrange(9)}" if rng.random() < 0.8 else f"own{i}") for i in range(600)]
    got = claim_keys(spark.createDataFrame(claims, "cmd_id long, scope string, owner string, key string").repartition(5),
                     spark.createDataFrame(holders, "scope string, owner string, key string"))
    assert {r["cmd_id"]: r["granted"] for r in got.collect()} == serial(claims, holders)


def test_a_rename_frees_the_slug(spark):
    teams = spark.createDataFrame([("a", "t", "A", "x"), ("b", "t", "B", "y"), ("c", "other", "C", "z")], "id string, tenant_id string, name string, slug string")
    members = spark.createDataFrame([(k, "u", "admin") for k in "abc"], "team_id string, user_id string, role string")
    cmds = [(1, "t", "b", "u", "New", "x"), (2, "other", "c", "u", None, "x"), (3, "t", "a", "u", None, "w"), (4, "t", "b", "u", None, "x"),
            (5, "t", "a", "u", None, "x"), (6, "t", "a", "u", None, "y"), (7, "t", "b", "u", None, "x"), (8, "t", "b", "u", "Last", None)]
    got = {r["cmd_id"]: (r["status"], r["name"], r["slug"]) for r in update_teams(
        spark.createDataFrame(cmds, "cmd_id long, tenant_id string, team_id string, user_id string, name string, slug string"), members, teams).collect()}
    assert got == {1: (409, None, None), 2: (200, "C", "x"), 3: (200, "A", "w"), 4: (200, "B", "x"), 5: (409, None, None), 6: (200, "A", "y"),
                   7: (200, "B", "x"), 8: (200, "Last", "x")}
