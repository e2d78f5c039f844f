"""Streaming forms equal their batch operators, over several micro-batches (ST2-ST4)."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from engram.operators import ingest as I
from engram.sources import fixtures as FX
from engram.streaming import streams as ST


def test_ingest_stream_equals_batch_store(spark):
    arrivals = FX.arrivals_fx(spark, SF_SMALL, chained=True)
    memories = FX.memories_fx(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="engram-st1-")
    arrivals.write.parquet(f"{root}/in")
    stream = ST.stream_table(spark, f"{root}/in", arrivals.schema)
    q = ST.ingest_stream(stream, f"{root}/snap", memories, FX.as_of_col(), f"{root}/chk",
                         outcomes_root=f"{root}/out")
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/out/b*")
                 .select("arrival_id", "action", "memory_id", "replaced_id").collect())
    want = sorted(tuple(r) for r in I.store(arrivals, memories)
                  .select("arrival_id", "action", "memory_id", "replaced_id").collect())
    assert got == want
    snap = spark.read.parquet(f"{root}/snap/v0")
    stored = [r for r in want if r[1] != "duplicate"]
    assert snap.count() == memories.count() + len(stored)
    replaced = {r[3] for r in want if r[1] == "replaced"}
    gone = {r["id"] for r in snap.filter(F.col("id").isin(list(replaced))).collect()
            if r["valid_until"] is not None}
    assert gone == replaced


def _stream(spark, root, batches, schema):
    """A file stream with one micro-batch per list of rows, in that order."""
    import os

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        for f in os.listdir(f"{root}/in"):  # files are read in order of their time
            path = f"{root}/in/{f}"
            if os.path.getmtime(path) > 1e9:
                os.utime(path, (i + 1, i + 1))
    return ST.stream_table(spark, f"{root}/in", spark.createDataFrame([], schema).schema, file_glob="*.parquet",
                           max_files=1)


def test_rate_limit_stream_keeps_trailing_keys(spark):
    root = tempfile.mkdtemp(prefix="engram-st3-")
    batches = [[("a", 100000, 1)], [("a", 200000, 2), ("b", 10, 3)], [("b", 20, 4)], [("b", 30, 5)], [("a", 200001, 6)]]
    s = _stream(spark, root, batches, "key string, t long, event_id long")
    got = {r["event_id"]: r["accepted"] for r in ST.run_to_table(ST.rate_limit_stream(s, n=2), "r").collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True}


def test_touch_stream_adds_up(spark):
    root = tempfile.mkdtemp(prefix="engram-st2-")
    memories = spark.createDataFrame([("m1", 3), ("m2", 0), ("m3", 0)], "id string, access_count bigint")
    batches = [[("q1", "m1", 0.5)], [("q2", "m1", 0.6), ("q2", "m2", 0.7)], [("q3", "m1", 0.8)], [("q4", "zz", 0.1)],
               [("q5", "m2", 0.2)]]
    s = _stream(spark, root, batches, "query_id string, id string, raw_similarity double")
    ST.touch_stream(s, memories, FX.as_of_col(), f"{root}/out", f"{root}/chk").awaitTermination()
    got = sorted((r["id"], r["access_count"], r["decay_score"]) for r in spark.read.parquet(f"{root}/out/latest").collect())
    assert got == [("m1", 6, 0.8), ("m2", 2, 0.2)]


def test_billing_stream_takes_late_and_drops_repeated_events(spark):
    from engram.operators import billing as B

    root = tempfile.mkdtemp(prefix="engram-st4-")
    tenants = spark.createDataFrame([(f"t{i}", "free", 10000, None) for i in range(1, 5)],
                                    "id string, plan string, memory_limit bigint, stripe_customer_id string")
    day = 86400

    def ev(i, ts):
        return (f"e{i}", B.CHECKOUT, ts, f"cus_{i}", f"s{i}", f"t{i}", "p", False)

    batches = [[ev(1, 100 * day)], [ev(2, 200 * day)], [ev(3, 10 * day)], [ev(1, 100 * day), ev(4, 5 * day)]]
    s = _stream(spark, root, batches, "event_id string, type string, ts bigint, customer string, subscription string, "
                                      "tenant_id string, price string, rejected boolean")
    ST.billing_stream(s, tenants, B.plans_table(spark, {"p": ("pro", 2000000)}), f"{root}/log", f"{root}/state",
                      f"{root}/chk").awaitTermination()
    assert {r["plan"] for r in spark.read.parquet(f"{root}/state/latest").collect()} == {"pro"}
    assert spark.read.parquet(f"{root}/log/b*").count() == 4
    assert spark.read.parquet(f"{root}/state/v3").count() == 4  # four batches ran
