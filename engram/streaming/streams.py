"""Structured Streaming forms of the continuous operators (ST1-ST5).

* ST1 ``ingest_stream``: fact arrivals per micro-batch -> M2 store against
  the previous snapshot, each batch overwriting snapshot ``v<batchId>`` (a
  replayed batch recomputes the same version, so the sink is idempotent).
* ST2 ``touch_stream``: returned-result streams -> M7 per micro-batch on top
  of the touches of the batches before.
* ST3 ``rate_limit_stream``: the U2 state machine per key with
  ``applyInPandasWithState``; state is (count, reset, start) per key.  No
  event is late: every one gets its outcome.
* ST4 ``billing_stream``: events whose id is in the log already are dropped,
  the rest are appended and B1 recomputed per micro-batch.
* ST5 ``metering_stream``: event-time tumbling (or sliding) windows with a
  watermark; ``session_stream``: sessions in append mode, with the rows that
  come too late in ``late_rows``.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.session import ensure_checkpoint_dir


def stream_table(spark: SparkSession, folder: str, schema, file_glob: str | None = None,
                 max_files: int | None = None) -> DataFrame:
    """A file stream over the parquet files of ``folder`` (optionally only
    the names matching ``file_glob``) with a fixed schema."""
    r = spark.readStream.schema(schema)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(folder)


def append_files(df: DataFrame, folder: str, files: int) -> None:
    """Append ``df`` to ``folder`` in exactly ``files`` files (empty ones make up the number), so that
    a stream which takes that many at a time has it in one micro-batch."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def count() -> int:
        found = system.listStatus(where) if system.exists(where) else []
        return sum(f.getPath().getName().endswith(".parquet") for f in found)

    due = count() + files
    df.coalesce(files).write.mode("append").parquet(folder)
    empty = spark.createDataFrame([], df.schema).coalesce(1)
    while count() < due:
        empty.write.mode("append").parquet(folder)


def _checkpoint_root(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark)


def run_to_table(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a streaming query over all available input (``availableNow``)
    into Parquet below the checkpoint folder and return that as a batch
    DataFrame.  In append mode each batch has a folder of its own, otherwise
    it replaces the one before.  Each run gets fresh names, so a second run
    re-reads the whole input."""
    import uuid

    spark = df.sparkSession
    root = f"{_checkpoint_root(spark).rstrip('/')}/stream-{name}-{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([], df.schema).write.parquet(f"{root}/out/empty")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/" + (f"b{batch_id}" if mode == "append" else "latest"))

    q = (df.writeStream.foreachBatch(per_batch).outputMode(mode)
         .option("checkpointLocation", checkpoint or f"{root}/chk").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out/*")


# --------------------------------------------------------------------------- ST5

def metering_stream(logs: DataFrame, window: str = "1 day", slide: str | None = None,
                    watermark: str = "1 day") -> DataFrame:
    """A10 as a stream: calls and results per tenant, endpoint and window.
    (Watermarks need TIMESTAMP event times; wall-clock inputs are read as
    the session's zone, UTC in this engine's sessions.)"""
    logs = logs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    w = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    return (logs.withWatermark("created_at", watermark)
            .groupBy("tenant_id", "endpoint", w.alias("w"))
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("result_count").alias("results")))


def session_stream(logs: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions of a user: calls with less than ``gap`` between them.  In append
    mode a session comes out once, when the watermark has passed its end, and
    its state goes; ``split_late`` gives rows behind the watermark an output of
    their own first."""
    logs = logs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return (logs.withWatermark("created_at", watermark)
            .groupBy("tenant_id", "user_id", F.session_window("created_at", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("calls"), F.sum("result_count").alias("results")))


def split_late(logs: DataFrame, root: str, checkpoint: str, watermark_seconds: int = 3600):
    """Deal the rows of a stream to ``in_time/b<k>`` and ``late/b<k>``: late are those before
    the greatest event time of the earlier batches less the delay.  ``marks/b<k>`` keeps that
    time, so a replayed batch is split alike.  A stream over ``in_time`` with the same
    watermark then drops nothing, since its own watermark is never ahead."""
    spark = logs.sparkSession
    logs = logs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    for part in ("in_time", "late"):
        spark.createDataFrame([], logs.schema).write.mode("overwrite").parquet(f"{root}/{part}/none")

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{root}/marks/b{batch_id - 1}").first()["mark"] if batch_id else None
        line = F.lit(before).cast("timestamp") - F.expr(f"interval {watermark_seconds} seconds")
        late = F.coalesce(F.col("created_at") < line, F.lit(False))
        batch.filter(late).write.mode("overwrite").parquet(f"{root}/late/b{batch_id}")
        batch.filter(~late).write.mode("overwrite").parquet(f"{root}/in_time/b{batch_id}")
        mark = batch.agg(F.max("created_at").alias("m")).select(F.greatest("m", F.lit(before).cast("timestamp")).alias("mark"))
        mark.coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/b{batch_id}")

    return (logs.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# --------------------------------------------------------------------------- ST3

RATE_OUT = "key string, event_id long, t long, accepted boolean, window_start long"
RATE_STATE = "count long, reset long, start long"


RUN = 1 << 19  # events of a key that are sorted at once
PIECE = 10_000  # rows of an output frame
NO_LONG = np.iinfo(np.int64).max  # in place of a null: sorts last


def _longs(column: pd.Series) -> np.ndarray:
    if column.dtype == np.int64:
        return column.to_numpy()
    return column.astype("Int64").to_numpy(dtype=np.int64, na_value=NO_LONG)


def _nullable(values: np.ndarray):
    none = values == NO_LONG
    return pd.arrays.IntegerArray(values, none) if none.any() else values


def _sorted_runs(pdfs: Iterator[pd.DataFrame], file, run: int) -> Iterator[np.ndarray]:
    """(t, event_id) rows in order, in pieces of about ``run`` rows.  More rows than that are sorted
    run by run into ``file`` and merged from there, so memory does not grow with a key's events."""
    def in_order(rows: np.ndarray) -> np.ndarray:
        return rows[np.lexsort((rows[:, 1], rows[:, 0]))]

    lengths: list[int] = []
    held: list[np.ndarray] = []
    n = 0
    for pdf in pdfs:
        held.append(np.column_stack([_longs(pdf["t"]), _longs(pdf["event_id"])]))
        n += len(pdf)
        if n >= run:
            in_order(np.concatenate(held)).tofile(file)
            lengths.append(n)
            held, n = [], 0
    last = in_order(np.concatenate(held)) if held else np.empty((0, 2), np.int64)
    if not lengths:
        yield last
        return
    last.tofile(file)
    lengths.append(n)
    at = np.cumsum([0, *lengths[:-1]])
    left = np.array(lengths)
    some = max(1, run // len(lengths))
    buffers = [np.empty((0, 2), np.int64) for _ in lengths]
    while True:
        for k in range(len(buffers)):
            if not len(buffers[k]) and left[k]:
                take = int(min(some, left[k]))
                file.seek(int(at[k]) * 16)
                buffers[k] = np.fromfile(file, np.int64, 2 * take).reshape(-1, 2)
                at[k] += take
                left[k] -= take
        ends = [tuple(b[-1]) for k, b in enumerate(buffers) if left[k]]  # behind these more may come
        line = min(ends) if ends else (NO_LONG, NO_LONG)
        out = []
        for k, b in enumerate(buffers):
            lo, hi = np.searchsorted(b[:, 0], line[0], "left"), np.searchsorted(b[:, 0], line[0], "right")
            cut = lo + np.searchsorted(b[lo:hi, 1], line[1], "right")
            out.append(b[:cut])
            buffers[k] = b[cut:]
        yield in_order(np.concatenate(out))
        if not ends:
            return


def _rate_fn(n: int, window_s: int, ttl_ms: int | None, run: int = RUN):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the service's periodic cleanup of idle entries
            state.remove()
            return
        count, reset, start = state.get if state.exists else (0, None, None)
        with tempfile.TemporaryFile() as file:
            for rows in _sorted_runs(pdfs, file, run):
                t = rows[:, 0]
                timed = int(np.searchsorted(t, NO_LONG))
                accepted, starts = np.zeros(len(t), bool), np.full(len(t), NO_LONG)
                i = 0
                while i < len(t):  # a window's events at once; those without a time open none
                    opens = i < timed and (reset is None or t[i] > reset)
                    if opens:
                        start = int(t[i])
                        count, reset = 0, start + window_s
                    end = i + int(np.searchsorted(t[i:timed], reset, "right")) if i < timed else len(t)
                    free = max(min(n - count, end - i), 1 if opens else 0)
                    accepted[i:i + free] = True
                    count += free
                    starts[i:end] = NO_LONG if start is None else start
                    i = end
                for k in range(0, len(t), PIECE):
                    here = slice(k, k + PIECE)
                    yield pd.DataFrame({"key": key[0], "event_id": _nullable(rows[here, 1]), "t": _nullable(t[here]),
                                        "accepted": accepted[here], "window_start": _nullable(starts[here])})
        state.update((count, reset, start))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return fn


def rate_limit_stream(events: DataFrame, n: int = 5, window_s: int = 3600,
                      ttl_ms: int | None = None) -> DataFrame:
    """U2 per key with per-key state; equal to the batch operator when each
    key's events arrive in time order.  Keys do not wait for one another: a
    watermark would drop the events of a key that trails the others.  A key's
    events of a batch are sorted in runs of bounded size.  State
    is three numbers per key; ``ttl_ms`` forgets a key that long idle on the
    clock, and must exceed the window and the delay of the input."""
    from engram.session import ship_package

    ship_package(events.sparkSession)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return events.groupBy("key").applyInPandasWithState(
        _rate_fn(n, window_s, ttl_ms), RATE_OUT, RATE_STATE, "append", timeout)


# --------------------------------------------------------------------------- ST1 / ST2 / ST4

def ingest_stream(arrivals: DataFrame, snapshot_root: str, initial: DataFrame, as_of,
                  checkpoint: str, outcomes_root: str | None = None):
    """ST1: foreachBatch(M2).  Batch b reads snapshot v<b-1> (or the
    initial one) and overwrites v<b> and its outcomes: a replayed batch
    recomputes the same result, so the sink is idempotent without listing
    folders."""
    from engram.operators import ingest as I
    from engram.sources.tables import write_snapshot

    spark = arrivals.sparkSession

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        mem = spark.read.parquet(f"{snapshot_root}/v{batch_id - 1}") if batch_id > 0 else initial
        out = I.store(batch, mem).checkpoint()
        if outcomes_root:
            out.write.mode("overwrite").parquet(f"{outcomes_root}/b{batch_id}")
        new = I.apply_outcomes(mem, batch, out, as_of)
        write_snapshot(new, f"{snapshot_root}/v{batch_id}", partition_by=None, mode="overwrite")

    return (arrivals.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def touch_stream(results: DataFrame, memories: DataFrame, as_of, sink_root: str, checkpoint: str,
                 order: str = "query_id"):
    """ST2: M7 per micro-batch.  Version ``v<batchId>`` (and ``latest``) has
    one row per memory touched so far; a batch starts from the version
    before it, so counts add up and a replayed batch writes the same rows."""
    from engram.operators.mutate import touch

    spark = results.sparkSession

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            new = touch(batch, memories, as_of, order)
        else:
            old = spark.read.parquet(f"{sink_root}/v{batch_id - 1}")
            counts = old.select("id", F.col("access_count").alias("_count"))
            now = (memories.join(counts, "id", "left")
                   .withColumn("access_count", F.coalesce("_count", "access_count")).drop("_count"))
            touched = touch(batch, now, as_of, order)
            new = touched.unionByName(old.join(batch.select("id"), "id", "left_anti"))
        new.write.mode("overwrite").parquet(f"{sink_root}/v{batch_id}")
        spark.read.parquet(f"{sink_root}/v{batch_id}").write.mode("overwrite").parquet(f"{sink_root}/latest")

    return (results.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def billing_stream(events: DataFrame, tenants: DataFrame, plans: DataFrame, log_root: str,
                   state_root: str, checkpoint: str):
    """ST4: redelivered events (an event id the log or the batch has already)
    are dropped, however late they or others come; each batch appends to the
    log and recomputes B1, writing version ``v<batchId>`` and ``latest``."""
    from engram.operators.billing import plan_state

    spark = events.sparkSession

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        earlier = [f"{log_root}/b{i}" for i in range(batch_id)]
        named = batch.filter(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
        if earlier:
            named = named.join(spark.read.parquet(*earlier).select("event_id"), "event_id", "left_anti")
        new = named.unionByName(batch.filter(F.col("event_id").isNull()))
        new.write.mode("overwrite").parquet(f"{log_root}/b{batch_id}")
        log = spark.read.parquet(*earlier, f"{log_root}/b{batch_id}")
        plan_state(log, tenants, plans).write.mode("overwrite").parquet(f"{state_root}/v{batch_id}")
        spark.read.parquet(f"{state_root}/v{batch_id}").write.mode("overwrite").parquet(f"{state_root}/latest")

    return (events.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
