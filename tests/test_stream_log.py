"""The store stream with all gates over several micro-batches, a crash before a commit, and
sessions with late rows."""

from __future__ import annotations

import os
import tempfile
from datetime import datetime, timedelta

import pytest

from engram.plans.store_queries import TEAM_PATTERN
from engram.sources import fixtures as FX
from engram.streaming import streams as ST
from engram.streaming.snapshots import SnapshotLog, gated_store_stream
from test_store_path import MEMORY, REQUEST, TEAMS, axis, request, run
from test_streams import _stream

LIMITS = [("t", 4), ("other", None)]


def batches():
    near = axis(0, (1, 0.25))
    return [
        [request(1, axis(0)), request(2, axis(1), tenant="other")],
        [request(3, near), request(4, axis(2)), request(5, axis(2))],
        [request(6, axis(3)), request(7, axis(4))],
        [request(8, axis(5)), request(9, axis(5), via="tool"), request(10, axis(6), importance=2.0)],
        [request(11, axis(5), via="tool"), request(12, axis(1, (2, 0.25)), tenant="other")],
    ]


def open_stream(spark, root, log, before_commit=None):
    source = ST.stream_table(spark, f"{root}/in", spark.createDataFrame([], REQUEST).schema, file_glob="*.parquet", max_files=1)
    return gated_store_stream(source, log, spark.createDataFrame(LIMITS, "id string, memory_limit bigint"),
                              spark.createDataFrame([("team1", "u", "member")], TEAMS[1]), spark.createDataFrame([("team1", "t")], TEAMS[0]),
                              FX.as_of_col(), f"{root}/chk", TEAM_PATTERN, before_commit)


def state(log):
    rows = log.read(log.newest()).collect()
    return {r["id"]: (r["tenant_id"], r["valid_until"] is None) for r in rows}


def test_five_batches_with_a_crash_equal_the_serial_store(spark):
    root = tempfile.mkdtemp(prefix="engram-log-")
    memories = [("old", "quiet", "u", "old", axis(9), 0.5, 1.0, 0, None, None, None, "api", "default", None, "private")]
    _stream(spark, root, batches(), REQUEST)
    log = SnapshotLog(spark, f"{root}/log")
    log.start(spark.createDataFrame(memories, MEMORY))
    calls = []

    def crash():  # the third batch dies after its data, before its commit
        calls.append(log.newest())
        if len(calls) == 3:
            raise RuntimeError("lost before the commit")

    with pytest.raises(Exception):
        open_stream(spark, root, log, crash).awaitTermination()
    assert log.newest() == 1 and len(calls) == 3
    half = state(log)
    assert "r06" not in half and half["r04"] == ("t", True)  # readers see the second version, whole
    open_stream(spark, root, log).awaitTermination()
    assert log.newest() == 4
    want_out, want_snap = run(spark, [r for b in batches() for r in b], LIMITS, memories)
    got = {r["arrival_id"]: r for r in log.outcomes().collect()}
    assert {k: tuple(got[k][c] for c in ("status", "action", "memory_id", "replaced_id", "count_before")) for k in got} == {
        k: tuple(want_out[k][c] for c in ("status", "action", "memory_id", "replaced_id", "count_before")) for k in want_out}
    assert state(log) == {k: (r["tenant_id"], r["valid_until"] is None) for k, r in want_snap.items()}
    assert {r["action"] for r in got.values()} == {"stored", "replaced", "duplicate", "refused", "rejected"}
    # the quiet tenant's rows were written once; each batch wrote only tenants that it changed
    assert {r["attempt"][:2] for r in log.manifest(4).filter("tenant_id = 'quiet'").collect()} == {"0-"}
    folders = {a: os.listdir(f"{root}/log/data/{a}") for a in os.listdir(f"{root}/log/data")}
    assert sum("tenant_id=quiet" in f for f in folders.values()) == 1
    # a batch that is run again finds its commit and changes nothing
    before = state(log)
    assert log.committed(4) and not log.committed(5)
    open_stream(spark, root, log).awaitTermination()
    assert state(log) == before and len(os.listdir(f"{root}/log/data")) == len(folders)


def test_sessions_close_and_late_rows_have_their_own_output(spark):
    root = tempfile.mkdtemp(prefix="engram-ses-")
    t0 = datetime(2024, 1, 1, 12)

    def row(minute, user="u", n=1):
        return ("t", user, n, t0 + timedelta(minutes=minute))

    rows = [[row(0), row(10)], [row(200), row(5, "v")], [row(30), row(205), row(210, "v")], [row(500)]]
    schema = "tenant_id string, user_id string, result_count long, created_at timestamp"
    stream = _stream(spark, root, rows, schema)
    ST.split_late(stream, f"{root}/split", f"{root}/chk").awaitTermination()
    late = spark.read.parquet(f"{root}/split/late/*").collect()
    # row(5, "v") is in time in its batch; row(30) comes behind 200 less 60 minutes
    assert [(r["user_id"], r["created_at"]) for r in late] == [("u", t0 + timedelta(minutes=30))]
    out = ST.run_to_table(ST.session_stream(ST.stream_table(spark, f"{root}/split/in_time/*", stream.schema, max_files=1)), "sessions")
    got = sorted((r["user_id"], (r["w"]["start"] - t0).seconds // 60, r["calls"]) for r in out.collect())
    assert got == [("u", 0, 2), ("u", 200, 2), ("v", 5, 1), ("v", 210, 1)]


def test_a_batch_has_as_many_files_as_are_read_at_once(spark):
    import tempfile

    from engram.streaming import streams as ST

    root = tempfile.mkdtemp(prefix="engram-files-")
    frame = spark.range(0, 4000, 1, 8).selectExpr("id", "id div 1000 k")
    for k in range(4):  # part 2 has no rows at all; the others lie in two of eight partitions
        ST.append_files(frame.filter(f"k = {k} and k <> 2"), f"{root}/in", 3)
    batches = {}

    def per_batch(batch, batch_id):
        batches[batch_id] = sorted(r["k"] for r in batch.select("k").distinct().collect())

    stream = ST.stream_table(spark, f"{root}/in", frame.schema, file_glob="*.parquet", max_files=3)
    stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", f"{root}/chk").trigger(availableNow=True).start().awaitTermination()
    assert batches == {0: [0], 1: [1], 2: [], 3: [3]}


def test_a_tenants_rows_are_written_by_several_tasks(spark, tmp_path):
    from engram.streaming.snapshots import SnapshotLog

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for large tables
    try:
        log = SnapshotLog(spark, str(tmp_path))
        log.start(spark.range(1000).selectExpr("concat('m', id) id", "'t' tenant_id", "concat('u', id % 20) user_id", "'n' namespace"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = log.read(-1)
    assert len(rows.inputFiles()) > 2 and rows.count() == 1000
    assert [tuple(r) for r in log.manifest(-1).select("tenant_id").collect()] == [("t",)]
