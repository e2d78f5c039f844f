"""Fixed-window rate limit anchored at each key's first event.

Rule (per key, events in time order): an event with no open window, or with
t > reset, opens a window [t, t + W] and is accepted; otherwise it is
rejected once the window already holds n accepted events.  Rejections do not
extend the window.

The windows' anchors form a chain: anchor_1 is the key's first event and
anchor_{k+1} is the first event with t > anchor_k + W.  Event j is accepted
iff fewer than n events precede it inside its window.  Instead of walking
the chain per key (which would put a hot key in one task), events are
range-sliced and the pointers next(i) are followed to the end of their slice
in one pass.  Only pointers from slice to slice are left, and these double:
log2(#slices of a key) rounds of joins on (key, index).  The rows where a
chain enters a slice give all its anchors in a second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.ingest import running_sum
from engram.session import ensure_checkpoint_dir, ship_package, stored


def _index(events: DataFrame, key: str, t: str, tie: str) -> DataFrame:
    """0-based position of each event within its key, in (t, tie) order."""
    return running_sum(events, key, [t, tie], F.lit(1), "idx")


def _next_pointer(idx: DataFrame, key: str, t: str, window_s: int) -> DataFrame:
    """next(i) = number of the key's events with time <= t_i + W, i.e. the
    index of the first event that would open the following window."""
    ev = idx.select(key, F.col(t).alias("_t"), F.lit(0).alias("_kind"), F.col("idx").alias("_o"),
                    F.lit(1).alias("_v"), F.lit(None).cast("bigint").alias("src"))
    probes = idx.select(key, (F.col(t) + F.lit(window_s)).alias("_t"), F.lit(1).alias("_kind"),
                        F.col("idx").alias("_o"), F.lit(0).alias("_v"), F.col("idx").alias("src"))
    counted = running_sum(ev.unionByName(probes), key, ["_t", "_kind", "_o"], F.col("_v"), "_before")
    return (counted.filter(F.col("_kind") == 1)
            .select(key, F.col("src").alias("idx"), F.col("_before").alias("nxt")))


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of a task, a slice of the log."""
    rows = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(rows) if rows else None


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the rows of a slice (sorted by key and idx): ``exit``, the first pointer of the row's
    chain that leaves the slice's part of the key (null when the key ends before)."""
    table = _whole(batches)
    if table is None:
        return
    start = table.column("part_start").to_numpy()
    idx, nxt, n = (table.column(c).to_numpy() for c in ("idx", "nxt", "n_key"))
    first = np.flatnonzero(start)
    which = np.cumsum(start) - 1
    last = np.append(first[1:], len(idx))[which] - 1  # the row that ends this part of the key
    low, high = idx[first][which], idx[last]
    out = nxt.copy()
    while True:  # pointers double inside the part
        inside = np.flatnonzero(out <= high)
        if not len(inside):
            break
        out[inside] = out[first[which[inside]] + out[inside] - low[inside]]
    yield from table.append_column("exit", pa.array(out, pa.int64(), mask=out >= n)).to_batches()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole slices (sorted by slice, key and idx) with ``entry`` on the rows where a chain comes
    in: ``anchor`` of each row, as far as it lies in the slice."""
    table = _whole(batches)
    if table is None:
        return
    start, entry = (table.column(c).to_numpy(zero_copy_only=False) for c in ("part_start", "entry"))
    idx, nxt = table.column("idx").to_numpy(), table.column("nxt").to_numpy()
    first = np.flatnonzero(start)
    ends = np.append(first[1:], len(idx))
    which = np.cumsum(start) - 1
    anchor = np.full(len(idx), -1)
    for at in np.flatnonzero(entry).tolist():  # one at most in each part of a key
        base, end = first[which[at]], ends[which[at]]
        while at < end:
            anchor[at] = idx[at]
            at = base + nxt[at] - idx[base]
    anchor = _running(anchor, first)
    yield from table.append_column("anchor", pa.array(anchor, pa.int64(), mask=anchor < 0)).to_batches()


def _running(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running maximum that begins anew at ``first``."""
    out = values.copy()
    for a, b in zip(first, np.append(first[1:], len(values))):
        np.maximum.accumulate(values[a:b], out=out[a:b])
    return out


def anchors(events: DataFrame, key: str, t: str, tie: str, window_s: int) -> DataFrame:
    """Mark each event with its window's anchor index (``anchor``) and its
    own index (``idx``)."""
    spark = events.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    idx = _index(events, key, t, tie).checkpoint()
    n_key = idx.groupBy(key).agg(F.count(F.lit(1)).alias("n_key"))
    # pointers inside a slice are followed at once
    chain = _next_pointer(idx, key, t, window_s).join(n_key, key).repartitionByRange(slices, key, "idx").sortWithinPartitions(key, "idx")
    chain = stored(chain.withColumn("slice", F.spark_partition_id()).select(key, "idx", "nxt", "n_key", "slice"))
    part = Window.partitionBy("slice").orderBy(key, "idx")
    chain = chain.withColumn("part_start", F.coalesce(F.lag(key).over(part) != F.col(key), F.lit(True)))
    fields = f"{key} {dict(events.dtypes)[key]}, idx bigint, nxt bigint, n_key bigint, slice int, part_start boolean"
    jumps = stored(chain.mapInArrow(_exits, f"{fields}, exit bigint"))
    # the rows where a chain enters a slice: pointers between slices double
    orbit = jumps.filter("idx = 0").select(key, "idx")
    jump = jumps.select(key, "idx", F.col("exit").alias("j"))
    while True:
        step = stored(orbit.join(jump, [key, "idx"]).filter("j is not null").select(key, F.col("j").alias("idx")))
        if step.isEmpty():
            break
        orbit = orbit.unionByName(step)
        after = jump.select(key, F.col("idx").alias("j"), F.col("j").alias("k"))
        jump = stored(jump.filter("j is not null").join(after, [key, "j"]).filter("k is not null").select(key, "idx", F.col("k").alias("j")))
    entered = jumps.drop("exit").join(orbit.withColumn("entry", F.lit(True)), [key, "idx"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    entered = entered.select(key, "idx", "nxt", "n_key", "slice", "part_start", "entry").repartition(slices, "slice").sortWithinPartitions("slice", key, "idx")
    marked = stored(entered.mapInArrow(_marks, f"{fields}, entry boolean, anchor bigint").select(key, "idx", "slice", "anchor"))
    # rows before the first anchor of their part: the last one of the parts before
    tops = marked.groupBy(key, "slice").agg(F.max("anchor").alias("top"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(key, "slice", F.max("top").over(before).alias("carry"))
    whole = marked.join(carry, [key, "slice"]).select(key, "idx", F.coalesce("anchor", "carry").alias("anchor"))
    return idx.join(whole, [key, "idx"])


def rate_limit(events: DataFrame, key: str = "key", t: str = "t", tie: str = "event_id",
               n: int = 5, window_s: int = 3600) -> DataFrame:
    """Adds ``accepted`` (bool), ``window_start`` (seconds) and ``n_before``
    (events before this one in its window).  ``t`` is in whole seconds."""
    a = anchors(events, key, t, tie, window_s)
    starts = a.filter(F.col("idx") == F.col("anchor")).select(
        key, F.col("idx").alias("anchor"), F.col(t).alias("window_start"))
    out = a.join(starts, [key, "anchor"])
    before = F.col("idx") - F.col("anchor")
    return (out.withColumn("n_before", before.cast("bigint"))
            .withColumn("accepted", before < F.lit(n))
            .drop("anchor"))
