"""W1 by blocked products equals every pair, also with pieces and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from engram.operators import ingest as I
from engram.operators import near
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = "tenant_id string, user_id string, namespace string, team_id string, embedding array<double>"


def sides(spark):
    rng = np.random.default_rng(5)

    def vec(k):
        if k % 30 == 3:
            return None
        if k % 30 == 4:
            return [0.0] * 4
        if k % 30 == 5:
            return [1e200, float("inf") if k % 60 == 5 else 1.0, 0.0, 1.0]
        if k % 30 == 6:
            return [1.0, float("nan"), 0.0, 1.0]
        return rng.integers(-1, 2, 4 if k % 11 else 3).astype(float).tolist()  # many equal ones

    def scope(k):
        return "t", f"u{k % 3}", "n", f"team{k % 2}" if k % 7 == 0 else None

    arrivals = [(f"a{k}", k, *scope(k), vec(k)) for k in range(120)] + [("alone", 999, "t", "nobody", "n", None, [1.0, 0.0, 0.0, 0.0])]
    memories = [(f"m{k}", *scope(k), vec(k + 7)) for k in range(150)]
    return (spark.createDataFrame(arrivals, f"arrival_id string, arrival_order bigint, {COLUMNS}").repartition(3),
            spark.createDataFrame(memories, f"id string, {COLUMNS}").withColumn("valid_until", F.lit(None).cast(T.TimestampNTZType())).repartition(3))


@pytest.mark.parametrize("tile", [None, 7])
def test_nearest_equals_every_pair(spark, tile):
    arrivals, memories = sides(spark)
    pairs = I._scope_join(I._probe(arrivals), I._rows(memories, "id", None))
    w = Window.partitionBy("arrival_id").orderBy(F.col("sim").desc_nulls_last(), F.col("dst").asc())
    want = {r["arrival_id"]: (r["dst"], repr(r["sim"])) for r in pairs.withColumn("n", F.row_number().over(w)).filter("n = 1").collect()}
    got = {r["arrival_id"]: (r["nearest_id"], repr(r["nearest_sim"])) for r in I.nearest_one(arrivals, memories, tile).collect()}
    assert got.pop("alone") == (None, "None") and {k: (a, b.replace("-0.0", "0.0")) for k, (a, b) in got.items()} == {
        k: (a, b.replace("-0.0", "0.0")) for k, (a, b) in want.items()} and len(got) == 120


def test_no_row_for_each_pair(spark):
    arrivals, memories = sides(spark)
    plan = I.nearest_one(arrivals, memories)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


@pytest.mark.parametrize("tile", [None, 9])
def test_best_sees_living_rows_only(spark, tile):
    rng = np.random.default_rng(2)
    side = "s1 string, s2 string, s3 string, s4 string, vec array<double>, norm double"

    def placed(v):
        return "t", "n", "u", "x", v, float(np.sqrt(np.cumsum(np.array(v) ** 2)[-1]))

    probes = [(f"q{k}", 10 * k, 1 + k % 5, *placed(rng.standard_normal(6).tolist())) for k in range(40)]
    rows = [(f"m{k}", 7 * k - 50, 7 * k + 90 if k % 3 else None, *placed(rng.standard_normal(6).tolist())) for k in range(60)]
    p = spark.createDataFrame(probes, f"src string, at bigint, k int, {side}")
    r = spark.createDataFrame(rows, f"dst string, born bigint, died bigint, {side}")
    found = {}
    for x in near.best(p, r, tile).collect():
        found.setdefault(x["src"], []).append((-x["sim"], x["dst"]))
    for src, at, k, *_, v, n in probes:
        alive = [(-float(np.cumsum(np.array(v) * np.array(m[-2]))[-1]) / (n * m[-1]), m[0]) for m in rows if m[1] < at and (m[2] is None or m[2] > at)]
        assert sorted(found.get(src, []))[:k] == sorted(alive)[:k]


def test_probes_are_not_copied_for_each_cell(spark):
    """Vectors without far cells: a probe meets a tile once."""
    from test_near import SIDE

    rng = np.random.default_rng(3)
    made = [(rng.standard_normal(16).tolist()) for _ in range(400)]
    side = [("t", "ns", "u", "u", v, float(np.sqrt(np.cumsum(np.array(v) ** 2)[-1]))) for v in made]
    probes = spark.createDataFrame([(f"a{k}", k, *x) for k, x in enumerate(side)], f"src string, arrival_order bigint, {SIDE}")
    rows = spark.createDataFrame([(f"m{k}", "memory", None, *x) for k, x in enumerate(side)], f"dst string, dst_kind string, dst_order bigint, {SIDE}")
    dealt, _ = near.tiles(probes, rows, 0.94, 100, 64)
    assert dealt.count() <= 400 * 5
