"""Sharding by histogram sort (law ``bytes``: shard sizes near equal).

Rows are ordered by a 64-bit hash of their text, then by one of their doc_id, so
equal texts lie together and are only divided where a shard boundary must fall
inside their group.  The boundaries are found without sorting: the key space is
cut into 2**DIGIT equal cells, the exact bytes of each cell are counted across all
partitions, and only the cells that hold a boundary are cut again, until the
bytes around every boundary are within the tolerance.  Then the rows are
exchanged once, to their shard and a part of it in which they are numbered.

DataFrame operations only.  Edge cases: a null text has size 1 and the checksum
of no bytes; equal rows (doc_id and text) share a key and a shard; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_width

SHARDS = 8
DIGIT = 10  # bits of the key that a round decides
KEY_BITS = 120  # 60 of the text's hash, 60 of the doc_id's
TOLERANCE = 0.002  # of a shard


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32 and the two halves of the key (60 bits each), and
    the columns to carry along."""
    text = F.coalesce("text", F.lit(""))
    half = lambda c: F.shiftrightunsigned(c, 4)
    return docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        half(F.xxhash64(text)).alias("k1"), half(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(1))).alias("k2"),
        *carry,
    )


def _digit(depth: int):
    """The key's digit number ``depth``."""
    at = depth * DIGIT
    half, shift = ("k1", 60 - DIGIT - at) if at < 60 else ("k2", 120 - DIGIT - at)
    return F.shiftright(half, shift).bitwiseAND((1 << DIGIT) - 1)


def _prefix(depth: int):
    """The key's first ``depth`` digits, as two numbers."""
    bits = depth * DIGIT
    return (
        F.shiftright("k1", 60 - min(bits, 60)) if bits else F.lit(0).cast("long"),
        F.shiftright("k2", 60 - (bits - 60)) if bits > 60 else F.lit(0).cast("long"),
    )


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """Keys (k1, k2) at which shards 1, 2, ... begin.  What comes to the driver in a
    round is one number for each cell of at most ``shards - 1`` divided cells."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    goal = [total * i / shards for i in range(1, shards)]
    allowed = tolerance * total / shards
    found: list[int | None] = [None] * (shards - 1)  # the boundary as a KEY_BITS number
    open_ = {0: (0, list(range(shards - 1)))}  # prefix -> bytes before it, its boundaries
    for depth in range(KEY_BITS // DIGIT):
        if not open_:
            break
        a, b = _prefix(depth)
        bits = depth * DIGIT
        split = lambda p: (p, 0) if bits <= 60 else (p >> (bits - 60), p & ((1 << (bits - 60)) - 1))  # noqa: B023, E731
        inside = F.lit(False)
        for p in open_:
            inside = inside | ((a == split(p)[0]) & (b == split(p)[1]))
        cells = keys.filter(inside).groupBy(a.alias("a"), b.alias("b"), _digit(depth).alias("d")).agg(F.sum("size").alias("n")).collect()
        at: dict[int, dict[int, int]] = {}
        for r in cells:
            p = r["a"] if bits <= 60 else (r["a"] << (bits - 60)) | r["b"]
            at.setdefault(p, {})[r["d"]] = r["n"]
        next_: dict[int, tuple[int, list[int]]] = {}
        for p, (before, wanted) in open_.items():
            run = before
            for d in range(1 << DIGIT):
                n = at.get(p, {}).get(d, 0)
                for i in wanted:
                    if found[i] is None and run + n >= goal[i]:
                        cell = (p << DIGIT) | d
                        low, high = goal[i] - run, run + n - goal[i]
                        last = depth == KEY_BITS // DIGIT - 1
                        if min(low, high) <= allowed or last:
                            found[i] = (cell if low <= high else cell + 1) << (KEY_BITS - bits - DIGIT)
                        elif i not in next_.get(cell, (0, []))[1]:
                            next_.setdefault(cell, (run, []))[1].append(i)
                            found[i] = -1  # in a cell that is divided further
                run += n
            for i in wanted:
                if found[i] is None:
                    found[i] = ((p + 1) << (KEY_BITS - bits)) if bits else 1 << KEY_BITS
        for _, wanted in next_.values():
            for i in wanted:
                found[i] = None
        open_ = next_
    return [(x >> 60, x & ((1 << 60) - 1)) for x in found]


def place(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, and the
    columns to carry along in the exchange."""
    keys = materialise(keyed(docs))
    rows = keys.count()
    shard = F.lit(0)
    for a, b in splitters(keys, shards, tolerance):
        shard = shard + ((F.col("k1") > a) | ((F.col("k1") == a) & (F.col("k2") >= b))).cast("int")
    parts = max(1, shuffle_width(docs.sparkSession) // shards, rows // (shards * 50_000))
    dealt = (keyed(docs, carry) if carry else keys).withColumn("shard", shard.cast("int")).withColumn("_part", F.pmod(F.xxhash64("doc_id", "k1", "k2"), F.lit(parts)).cast("int"))
    counts = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.select(
        "shard", "_part",
        F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    order = Window.partitionBy("shard", "_part").orderBy("k1", "k2", "doc_id")
    numbered = dealt.withColumn("_rank", F.row_number().over(order) - 1).join(before, ["shard", "_part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") + F.col("_before")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *carry,
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the texts with their places, one folder per shard."""
    place(docs, shards, carry=("text",)).write.partitionBy("shard").parquet(path)
