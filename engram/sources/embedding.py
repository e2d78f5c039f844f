"""Embeddings: attach precomputed vectors by text (S6), run a caller's
batch model (S7), and a deterministic hashed-trigram embedder (S8).

The service sends trimmed text to a remote model and restores order by
index; an empty batch gives nothing.  Here the vectors either come from a
table keyed by text (S6), from the caller's model applied per Arrow batch
(S7), or from S8, which needs no model at all.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_embeddings(facts: DataFrame, vectors: DataFrame, text_col: str = "fact",
                      dim: int | None = None) -> DataFrame:
    """Equi-join facts to a (text, embedding) table on a hash of the
    trimmed text, confirmed by the text itself; optionally check the
    dimension (wrong size -> null vector)."""
    v = vectors.select(F.xxhash64(F.trim("text")).alias("_h"), F.trim("text").alias("_t"),
                       F.col("embedding").alias("_vec"))
    f = facts.withColumn("_h", F.xxhash64(F.trim(F.col(text_col)))).withColumn("_t", F.trim(F.col(text_col)))
    j = f.join(v, ["_h", "_t"], "left")
    vec = F.col("_vec")
    if dim is not None:
        vec = F.when(F.size(vec) == dim, vec)
    return j.withColumn("embedding", vec).drop("_h", "_t", "_vec")


def embed_with(df: DataFrame, model: Callable[[list[str]], np.ndarray], text_col: str = "text",
               out: str = "embedding") -> DataFrame:
    """Apply a caller-supplied batch model (list of trimmed texts ->
    2-D array) to each Arrow batch; order within the batch is kept."""
    from pyspark.sql import types as T

    from engram.session import ship_package

    ship_package(df.sparkSession)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            texts = pdf[text_col].fillna("").str.strip().tolist()
            vecs = np.asarray(model(texts), dtype=np.float32)
            yield pdf.assign(**{out: list(vecs)})

    return df.mapInPandas(run, schema)


CHUNK = 1 << 20  # code points of texts that are counted at once


def _bucket_counts(texts: list[str], dim: int, known: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of the trigrams of ``texts``; ``known`` keeps the buckets
    of the trigrams (three code points as one number) that this worker has met."""
    import hashlib

    sizes = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    grams = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    ends = np.cumsum(sizes)
    inside = np.ones(len(points), dtype=bool)  # a trigram does not run over the end of its text
    for back in (1, 2):
        inside[(ends - back)[sizes >= back]] = False
    inside = inside[:-2]
    distinct, which = np.unique(grams[inside], return_inverse=True)
    if len(known) > 1_000_000:
        known.clear()
    buckets = np.empty(len(distinct), dtype=np.int64)
    for k, g in enumerate(distinct.tolist()):
        if g not in known:
            gram = chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF)
            known[g] = int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % dim
        buckets[k] = known[g]
    rows = np.repeat(np.arange(len(texts)), sizes)[:-2][inside]
    counts = np.bincount(rows * dim + buckets[which], minlength=1)
    hit = np.flatnonzero(counts)
    return hit // dim, hit % dim, counts[hit]


def trigram_buckets(df: DataFrame, text_col: str, dim: int) -> DataFrame:
    """S8 (sparse form): character trigrams (code points) of the whole text,
    each hashed to one of ``dim`` buckets by the first 32 bits of its MD5;
    returns (key columns..., bucket, cnt).  Trigrams are counted where their
    text is, a bounded stretch of texts at a time, so at most ``dim`` rows a
    text are shuffled."""
    from pyspark.sql import types as T

    from engram.session import ship_package

    ship_package(df.sparkSession)
    keys = [c for c in df.columns if c != text_col]
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        # few input files: spread the texts before the counting
        df = df.repartition(par)
    schema = T.StructType([df.schema[c] for c in keys] + [T.StructField("bucket", T.LongType()), T.StructField("cnt", T.LongType())])

    def run(batches):
        known: dict[int, int] = {}
        for batch in batches:
            text, rest = batch.column(text_col), batch.select(keys)
            at, texts, held = [], [], 0
            for k in range(batch.num_rows):
                t = text[k].as_py()
                if t is not None and len(t) >= 3:
                    at.append(k)
                    texts.append(t)
                    held += len(t)
                if texts and (held >= CHUNK or k == batch.num_rows - 1):
                    row, bucket, cnt = _bucket_counts(texts, dim, known)
                    of = rest.take(pa.array(np.array(at)[row]))
                    yield pa.RecordBatch.from_arrays([*of.columns, pa.array(bucket, pa.int64()), pa.array(cnt, pa.int64())],
                                                     names=[*keys, "bucket", "cnt"])
                    at, texts, held = [], [], 0

    g = df.select(*keys, text_col).mapInArrow(run, schema)
    return g.groupBy(*keys, "bucket").agg(F.sum("cnt").alias("cnt"))


def dense(sparse: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """S8 (dense form): sparse (bucket, cnt) rows -> one L2-normalised
    array<double> of length ``dim`` per key (at most ``dim`` entries per
    key are gathered, a fixed bound)."""
    agg = sparse.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "cnt"))).alias("_m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: F.coalesce(F.element_at("_m", i), F.lit(0)).cast("double"))
    a = agg.withColumn("_v", vec)
    n = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x * x))
    return a.select(*keys, F.transform("_v", lambda x: F.when(n > 0, x / n).otherwise(x)).alias("embedding"))


def hashed_trigram_model(dim: int) -> Callable[[list[str]], np.ndarray]:
    """A numpy version of S8 for S7's contract (used on the Python side of
    ``embed_with``): the same buckets, L2-normalised."""
    import hashlib

    known: dict[str, int] = {}  # buckets of the trigrams that this worker has met

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        if len(known) > 1_000_000:
            known.clear()
        for r, text in enumerate(texts):
            grams = [text[i:i + 3] for i in range(len(text) - 2)]
            for g in set(grams) - known.keys():
                known[g] = int(hashlib.md5(g.encode("utf-8")).hexdigest()[:8], 16) % dim
            if grams:
                out[r] = np.bincount([known[g] for g in grams], minlength=dim)
                out[r] /= np.linalg.norm(out[r])
        return out

    return model


__all__ = ["attach_embeddings", "embed_with", "trigram_buckets", "dense", "hashed_trigram_model", "pd"]
