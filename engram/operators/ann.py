"""Approximate search by a stored index of inverted lists (V2) and its recall (V3).

The service's vector index is an IVF list index (lists = 100).  Here the lists
are a Parquet table partitioned by centroid id, next to a table of centroids:
built once, appended to, and read by any session.  A memory lies in the list
of its nearest centroid; a query probes its ``probes`` nearest lists.  Only the
partitions that some query of the batch probes are read, and the centroid id
joins as one more equi-key next to the scope keys, so a query meets only rows
of its lists.  Centroids (at most ``MAX_LISTS``) are the one thing that travels
to the driver and the tasks; assignment is a matrix product per Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.vectors import norm
from engram.operators import retrieval as R
from engram.session import ship_package, stored


MAX_LISTS = 65536
SCORE_DIGITS = 9  # scores are compared rounded, so that equal ones go to the lesser centroid


def _unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def kmeans_centroids(memories: DataFrame, lists: int = 100, seed: int = 7, max_iter: int = 20) -> DataFrame:
    """Centroids (cid, centroid) by k-means over the unit active vectors, renormalised."""
    act = R.active(memories).select(_unit(F.col("embedding").cast("array<double>")).alias("u"))
    data = act.select(array_to_vector("u").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=max_iter, featuresCol="features").fit(data)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    table = memories.sparkSession.createDataFrame(rows, "cid int, centroid array<double>")
    return table.withColumn("centroid", _unit(F.col("centroid")))


def _centroids(path: str, spark) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.parquet(f"{path}/centroids").sort("cid").limit(MAX_LISTS + 1).collect()
    if len(rows) > MAX_LISTS:
        raise ValueError(f"more than {MAX_LISTS} lists")
    return np.array([r["cid"] for r in rows], np.int32), np.array([r["centroid"] for r in rows], np.float64)


def _nearest(df: DataFrame, vector: str, out: str, path: str, count: int) -> DataFrame:
    """Adds ``out``: the ids of the ``count`` nearest centroids, the nearest first (none
    without a direction or of another dimension)."""
    from pyspark.sql import types as T

    ship_package(df.sparkSession)
    ids, table = _centroids(path, df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((ids, table))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        ids, table = shared.value
        for batch in batches:
            near: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for k, v in enumerate(batch.column(batch.schema.names.index(vector)).to_pylist()):
                if v is None or len(v) != table.shape[1] or None in v:
                    continue
                x = np.array(v, np.float64)
                size = np.sqrt((x * x).sum())
                if 0 < size < np.inf:
                    score = np.round(table @ (x / size), SCORE_DIGITS)
                    near[k] = ids[np.argsort(-score, kind="stable")[:count]].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def build_index(memories: DataFrame, centroids: DataFrame, path: str) -> str:
    """Write a new index of the active memories to ``path``: ``centroids`` (cid, centroid)
    and ``lists`` partitioned by cid."""
    centroids.select(F.col("cid").cast("int").alias("cid"), "centroid").coalesce(1).write.parquet(f"{path}/centroids")
    return extend_index(memories, path)


def extend_index(memories: DataFrame, path: str) -> str:
    """Add memories to the lists.  Vectors without a direction go to list -1, which no query
    probes (their similarity is null anywhere)."""
    m = R.active(memories).withColumn("embedding", F.col("embedding").cast("array<double>"))
    m = _nearest(m, "embedding", "_near", path, 1).withColumn("cid", F.coalesce(F.try_element_at("_near", F.lit(1)), F.lit(-1))).drop("_near")
    m.repartition("cid").sortWithinPartitions("cid", "tenant_id", "user_id", "namespace").write.mode("append").partitionBy("cid").parquet(f"{path}/lists")
    return path


def probe_lists(queries: DataFrame, path: str, probes: int) -> DataFrame:
    """One row per (query, probed list): ``q_cid``."""
    q = queries.withColumn("vector", F.col("vector").cast("array<double>"))
    return _nearest(q, "vector", "_near", path, probes).withColumn("q_cid", F.explode("_near")).drop("_near")


def probed_rows(probed: DataFrame, path: str) -> DataFrame:
    """The rows of the lists that some query probes; the other partitions are not read."""
    spark = probed.sparkSession
    wanted = [r[0] for r in probed.select("q_cid").distinct().collect()]  # at most MAX_LISTS
    return spark.read.parquet(f"{path}/lists").filter(F.col("cid").isin(wanted))


def ivf_search(queries: DataFrame, path: str, as_of, probes: int = 10, members: DataFrame | None = None,
               teams: DataFrame | None = None, max_limit: int | None = None) -> DataFrame:
    """R1 restricted to the probed lists of a stored index: same gate, scope,
    ranking and projection; rows outside the probed lists are never paired."""
    from engram.functions import scalars as S

    q = R.gate_queries(queries, members, teams, "search")
    if max_limit is None:
        max_limit = R._max_limit(q, 50)
    probed = stored(probe_lists(q.filter("status = 200"), path, probes))
    rows = probed_rows(probed, path)
    pairs = R.scoped_pairs(probed, rows, with_vector=True, extra_keys=[("q_cid", "cid")])
    cands = R.topk_candidates(pairs, max_limit)
    dec = S.decay("created_at", "importance", as_of)
    cands = cands.withColumn("_decay", dec).withColumn("decay_score", S.round4("_decay"))
    ranked = R._rerank(cands, S.round4("sim"), S.round4(S.blend("sim", "_decay")), max_limit=max_limit)
    return R._project(R._with_facts(ranked, rows))


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """V3: per query |approx top-k ∩ exact top-k| / |exact top-k|, and the
    mean over queries with a non-empty exact answer."""
    a = approx.filter(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("_hit"))
    e = exact.filter(F.col("rank") <= k).select("query_id", "id")
    per = (e.join(a, ["query_id", "id"], "left").groupBy("query_id")
           .agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1))).alias("recall")))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 4).alias("recall_at_k"),
                   F.lit(k).alias("k"))


__all__ = ["kmeans_centroids", "build_index", "extend_index", "probe_lists", "probed_rows", "ivf_search", "recall_at_k"]
