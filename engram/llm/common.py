"""Helpers shared by the operators: shared-folder tables, Arrow mapping, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from engram.session import ensure_checkpoint_dir, ship_package

U64 = np.uint64
ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
}


def store(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` as Parquet into a new folder under
    ``spark.checkpoint.dir`` and read it back; also the folder.  It is shared by the
    driver and all executors, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/engram-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written and read back."""
    return store(df)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Remove a stored table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def map_batches(df: DataFrame, schema: dict[str, str], rows: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """``df.mapInArrow`` where ``rows`` turns the columns of a record batch (lists)
    into the columns of the output batch (lists of any equal length)."""
    ship_package(df.sparkSession)
    fields = [(k, ARROW[v]) for k, v in schema.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few MB of text at a time, whatever the batch size Spark chose
            step = max(1, int(batch.num_rows * 8e6 / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, step):
                out = rows(batch.slice(at, step).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in fields], names=[k for k, _ in fields])

    return df.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in schema.items()))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 18


class _Powers:
    """Powers of the hash base and of its inverse, grown to the longest word run met."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, _SLICE)
            self.up, self.down = np.full(n, _BASE, U64), np.full(n, _UNBASE, U64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)


_POWERS = _Powers()


def separators(pattern: bytes) -> np.ndarray:
    """Byte table that is true for the bytes in ``pattern``."""
    table = np.zeros(256, bool)
    table[list(pattern)] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = separators(b" \t\n\x0b\x0c\r")


def word_spans(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs without separators."""
    edge = np.diff(np.concatenate(([True], breaks[raw], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: tuple[int, ...] = ()) -> np.ndarray:
    """One 64-bit hash for each byte span (spans ascend and don't overlap); with
    ``heads``, also rows with the hashes of the spans cut to so many bytes.

    Prefix sums of byte * base**position give any span's polynomial hash as a
    difference, scaled back by the inverse power; all modulo 2**64."""
    out = np.empty((1 + len(heads), len(starts)), U64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _SLICE)))
        high = ends[to - 1]
        _POWERS.grow(int(high - low) + 1)
        sums = np.zeros(high - low + 1, U64)
        np.cumsum((raw[low:high].astype(U64) + U64(1)) * _POWERS.up[: high - low], out=sums[1:])
        a, whole = starts[at:to] - low, ends[at:to] - low
        for k, size in enumerate((None, *heads)):
            b = whole if size is None else np.minimum(whole, a + size)
            out[k, at:to] = (sums[b] - sums[a]) * _POWERS.down[a] + (b - a).astype(U64) * U64(0xD1342543DE82EF95)
        at = to
    out = mix(out)
    return out if heads else out[0]


def lower_words(text: str | None, breaks: np.ndarray = SPACES) -> np.ndarray:
    """Hashes of the words of a text in order, A-Z lower-cased."""
    raw = LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    return span_hashes(raw, *word_spans(raw, breaks))
