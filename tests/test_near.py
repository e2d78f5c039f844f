"""V1 by blocked products equals all pairs, also with cells and pieces."""

from __future__ import annotations

import numpy as np
import pytest

from conftest import SF_SMALL
from engram.operators import ingest as I
from engram.operators import near
from engram.sources import fixtures as FX

SIDE = "s1 string, s2 string, s3 string, s4 string, vec array<double>, norm double"


def sides(spark, n, dim, clusters, seed):
    """Vectors around cluster centres in two scopes, some of other lengths."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))

    def vec(k):
        if k % 50 == 7:
            return rng.standard_normal(3).tolist()
        return (centres[rng.integers(clusters)] + 0.2 * rng.standard_normal(dim)).tolist()

    def side(k, v):
        return ("t", "ns", "u", f"u{k % 2}", v, float(np.sqrt(np.cumsum(np.array(v) ** 2)[-1])))

    rows = [(f"m{k}", "memory", None, *side(k, vec(k))) for k in range(n)]
    probes = [(f"a{k}", k, *side(k, vec(k))) for k in range(n)]
    rows += [(p[0], "arrival", p[1], *p[2:]) for p in probes]
    want = {}
    for p in probes:
        for r in rows:
            if p[5] == r[6] and len(p[6]) == len(r[7]) and (r[2] is None or r[2] < p[1]):
                sim = float(np.cumsum(np.array(p[6]) * np.array(r[7]))[-1]) / (p[7] * r[8])
                if sim >= 0.94:
                    want[p[0], r[0]] = sim
    return (spark.createDataFrame(probes, f"src string, arrival_order bigint, {SIDE}").repartition(3),
            spark.createDataFrame(rows, f"dst string, dst_kind string, dst_order bigint, {SIDE}").repartition(3), want)


@pytest.mark.parametrize("tile", [1, 16, 4096])
def test_pairs_equal_all_pairs(spark, tile):
    n = 40 if tile == 1 else 150
    probes, rows, want = sides(spark, n, 12, 9, tile)
    got = {(r["src"], r["dst"]): r["sim"] for r in near.pairs_above(probes, rows, 0.94, tile, 16).collect()}
    assert len(want) > 20 and got == want


def test_cells_leave_out_far_tiles(spark):
    probes, rows, want = sides(spark, 300, 32, 12, 1)
    every = near.compared(probes, rows, 0.94, 10**6)
    some = near.compared(probes, rows, 0.94, 32, 64)
    assert every == 2 * 150 * 300 and some < 0.4 * every


def test_fixture_pairs_with_small_tiles(spark, monkeypatch):
    arrivals, memories = FX.arrivals_fx(spark, SF_SMALL, chained=True), FX.memories_fx(spark, SF_SMALL)
    whole = sorted(map(tuple, I.near_pairs(arrivals, memories).collect()))
    cut = sorted(map(tuple, near.pairs_above(*I._near_sides(arrivals, memories), 0.94, 8, 16).collect()))
    assert whole == cut and len(whole) > 100


def test_bound_on_products_drops_no_pair(spark, monkeypatch):
    """Pairs are the same with the bound from few entries as with whole products, also where the
    bound drops nothing (all vectors alike) and for pairs at the very bound."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = unit(rng.standard_normal((200, 64))).astype(np.float32)
    across = rng.standard_normal((200, 64))
    across = unit(across - (across * a).sum(1, keepdims=True) * a)
    b = (0.94 * a + np.sqrt(1 - 0.94**2) * across).astype(np.float32)
    for x, y in ((a, b), (a, a[::-1]), (unit(1 + 0.01 * a), unit(1 + 0.01 * b))):
        assert (near._short(x) @ near._short(y).T >= x @ y.T - near._margin(64)).all()
    few, whole = near._short(a) @ near._short(a).T >= 0.94, a @ a.T >= 0.94
    assert whole.sum() == 200 and few.sum() < 400
    probes, rows, want = sides(spark, 400, 64, 12, 9)
    calls = []
    monkeypatch.setattr(near, "ship_package", calls.append)
    got = {(r["src"], r["dst"]): r["sim"] for r in near.pairs_above(probes, rows, 0.94).collect()}
    assert len(want) > 200 and got == want and calls


def test_flags_are_found():
    rng = np.random.default_rng(6)
    for shape in ((1, 1), (3, 5), (17, 33), (0, 4), (64, 64)):
        hits = rng.random(shape) < 0.1
        assert near._places(hits).tolist() == np.flatnonzero(hits).tolist()


def test_cells_only_where_some_are_far():
    rng = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    assert not near._apart(unit(rng.standard_normal((64, 64))), 0.94)
    assert near._apart(unit(np.repeat(rng.standard_normal((8, 64)), 8, axis=0) + 0.1 * rng.standard_normal((64, 64))), 0.94)
    assert near._apart(np.ones((1, 4)) / 2, 0.94)
