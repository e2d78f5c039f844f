"""Searches over rows that live for a time: candidates found and ranked in one place, as every pair would give them."""

from __future__ import annotations

import numpy as np
import pytest

from engram.functions import scalars as S
from engram.operators import near
from engram.operators import retrieval as R
from engram.session import ensure_checkpoint_dir, passing, stored
from engram.sources import fixtures as FX
from pyspark.sql import functions as F

SIDE = "s1 string, s2 string, s3 string, s4 string, vec array<double>, norm double"


def placed(v, user="x"):
    return "t", "n", "u", user, v, float(np.sqrt(np.cumsum(np.array(v) ** 2)[-1]))


def sides(spark):
    rng = np.random.default_rng(7)

    def vec(k):
        v = rng.integers(-1, 2, 4 if k % 9 else 3).astype(float).tolist()  # many equal ones
        return v if any(v) else [1.0] * len(v)

    probes = [(k, 10 * k, k % 6, *placed(vec(k), f"u{k % 3}")) for k in range(90)]
    rows = [(f"m{k}", None if k % 7 == 0 else 9 * k - 60, 9 * k + 200 if k % 3 else None, *placed(vec(k), f"u{k % 4}")) for k in range(140)]
    return probes, rows, spark.createDataFrame(probes, f"src bigint, at bigint, k int, {SIDE}").repartition(3), spark.createDataFrame(
        rows, f"dst string, born bigint, died bigint, {SIDE}").withColumn("mark", F.length("dst").cast("double")).repartition(4)


@pytest.mark.parametrize("tile", [None, 8, 40])
def test_nearest_equals_every_pair(spark, tile):
    probes, rows, p, r = sides(spark)
    whole, cut = near.nearest(p, r, tile)
    assert (cut is None) == (tile != 8)
    found = {}
    for x in (whole if cut is None else whole.unionByName(cut)).collect():
        assert all(m["mark"] == len(m["dst"]) for m in x["found"])
        found.setdefault(x["src"], []).extend((-m["sim"], m["dst"]) for m in x["found"])
    for src, at, k, *scope, v, n in probes:
        alive = [(-float(np.cumsum(np.array(v) * np.array(m[-2]))[-1]) / (n * m[-1]), m[0]) for m in rows
                 if m[3:7] == tuple(scope) and len(m[-2]) == len(v) and (m[1] is None or m[1] < at) and (m[2] is None or m[2] > at)]
        assert sorted(found.get(src, []))[:k] == sorted(alive)[:k]
        if cut is None:  # no pair beyond the nearest leaves its task
            assert found.get(src, []) == sorted(alive)[:k]


def test_chunks_of_a_part_are_joined(spark, monkeypatch):
    _, _, p, r = sides(spark)
    want = near.nearest(p, r)[0].collect()
    monkeypatch.setattr(near, "ENTRIES", 64)
    batches = p.select(F.lit(0).alias("part"), F.lit(0).alias("sub"), F.lit(0).alias("piece"), F.size("vec").alias("dim"), F.lit(0).alias("side"),
                       "src", F.lit(None).cast("string").alias("dst"), F.col("at").alias("begin"), F.lit(None).cast("bigint").alias("died"), "k",
                       F.lit(None).cast("double").alias("mark"), "vec", "norm", "s4")
    other = r.select(F.lit(0).alias("part"), F.lit(0).alias("sub"), F.lit(0).alias("piece"), F.size("vec").alias("dim"), F.lit(1).alias("side"),
                     F.lit(None).cast("bigint").alias("src"), "dst", F.coalesce("born", F.lit(-(1 << 63)).cast("bigint")).alias("begin"),
                     F.coalesce("died", F.lit((1 << 63) - 1).cast("bigint")).alias("died"), F.lit(None).cast("int").alias("k"), "mark", "vec", "norm", "s4")
    got = {}
    for user in ("u0", "u1", "u2"):
        for dim in (3, 4):
            table = batches.unionByName(other).filter(f"s4 = '{user}' and dim = {dim} and (side = 1 or k > 0)").orderBy("side", "dst").toArrow()
            for batch in near._parts_found(b.drop_columns(["s4"]) for b in table.combine_chunks().to_batches(max_chunksize=7)):
                for x in batch.to_pylist():
                    got[x["src"]] = [(m["dst"], m["sim"]) for m in x["found"]]
    assert {x["src"]: [(m["dst"], m["sim"]) for m in x["found"]] for x in want if x["found"]} == {k: v for k, v in got.items() if v}


def test_rows_go_to_the_times_they_live_in(spark, monkeypatch):
    """Rows that are soon replaced are not copied for every slice of a scope's queries."""
    v = placed([1.0, 2.0])
    p = spark.createDataFrame([(k, 10 * k, 2, *v) for k in range(400)], f"src bigint, at bigint, k int, {SIDE}")
    r = spark.createDataFrame([(f"m{k}", 10 * k - 5, 10 * k + 15, *v) for k in range(0, 400, 2)], f"dst string, born bigint, died bigint, {SIDE}")
    dealt = []
    monkeypatch.setattr(near, "_parts_found", lambda batches: iter(()))
    plain = type(p).sortWithinPartitions
    monkeypatch.setattr(type(p), "sortWithinPartitions", lambda self, *a: dealt.append(self) or plain(self, *a))
    near.nearest(p, r, 20)
    assert dealt[0].filter("side = 1").count() <= 260 and dealt[0].filter("side = 0").count() == 400


def memories_and_queries(spark):
    rng = np.random.default_rng(11)

    def vec(k):
        odd = {3: None, 4: [0.0] * 4, 5: [1e200, 1.0, 0.0, 1.0], 6: [1.0, float("nan"), 0.0, 1.0]}
        return odd[k % 40] if k % 40 in odd else rng.integers(-1, 2, 4).astype(float).tolist()

    # u2 has no odd rows
    mem = [(f"m{k}", "t", u := f"u{k % 3}", f"fact {k}", vec(7 if u == "u2" else k), None if k % 17 == 0 else k % 11 / 10, f"s{k % 2}", "n",
            None if k % 4 else "team", "team" if k % 8 == 0 else "private", 5 * k - 40, 5 * k + 150 if k % 3 else None, k % 20) for k in range(130)]
    m = spark.createDataFrame(mem, "id string, tenant_id string, user_id string, fact string, embedding array<double>, importance double, "
                              "source string, namespace string, team_id string, visibility string, born bigint, died bigint, age int")
    m = m.selectExpr("* except (age)", "timestampadd(DAY, age, timestamp_ntz'2024-01-01') created_at", "cast(null as timestamp_ntz) valid_until")
    ask = [(k, k * 6, "t", f"u{k % 3}", "n", vec(k + 1), k % 7 if k % 5 else None, [None, "", "s0", "s1"][k % 4], "team" if k % 2 else None, False) for k in range(100)]
    q = spark.createDataFrame(ask, "query_id bigint, at bigint, tenant_id string, user_id string, namespace string, vector array<double>, q_limit int, "
                              "source string, team_id string, include_team boolean")
    return q, m


def test_search_equals_every_pair(spark):
    q, m = memories_and_queries(spark)
    gated = R.gate_queries(q, None, None, "search")
    cands = R.topk_candidates(R.scoped_pairs(gated, m, with_vector=True, versioned=True), 50)
    dec = S.decay("created_at", "importance", FX.as_of_col())
    cands = cands.withColumn("_decay", dec).withColumn("decay_score", S.round4("_decay"))
    ranked = R._rerank(cands, S.round4("sim"), S.round4(S.blend("sim", "_decay")))
    want = R._project(R._with_facts(ranked, m)).collect()
    got = R.search(q, m, FX.as_of_col(), versioned=True).collect()
    assert sorted(repr(x).replace("-0.0", "0.0") for x in got) == sorted(repr(x).replace("-0.0", "0.0") for x in want)
    assert len(got) > 200 and any(x["similarity"] is None for x in got)


def test_no_pair_is_shuffled_to_be_ranked(spark):
    q, m = memories_and_queries(spark)
    plain = "embedding is not null and not exists(embedding, x -> isnan(x)) and aggregate(embedding, 0d, (a, x) -> a + x * x) between 0.5 and 100"
    found = R.search(q.filter(plain.replace("embedding", "vector")), m.filter(plain), FX.as_of_col(), versioned=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_passing_tables_are_deleted(spark):
    from pathlib import Path

    def there():
        return {p.name for p in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("stored-*")}

    before = there()
    with passing(spark) as keep:
        first = stored(spark.range(5))
        with passing(spark) as inner:
            second = inner(first.filter("id > 1"))
        kept = keep(second)
        assert second.count() == 3
    assert len(there() - before) == 1 and kept.count() == 3


def test_only_texts_that_memories_take_are_read(spark):
    plan = FX.memories_fx(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" in plan and ">= scalar-subquery" in plan
