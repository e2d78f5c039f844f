"""A log of snapshot versions: data first, then one small commit.

Every version is a *manifest*: one row per tenant that names the attempt whose
folder holds the tenant's rows.  A batch writes the rows of the tenants it
changes to a folder of its own (``data/attempt=<id>/tenant_id=<t>``), and then
the manifest (``commits/b<k>``) in which only those tenants point there.
Readers go by the newest whole manifest, so they never see half a version; an
attempt that died before its commit is in no manifest; a batch that has its
commit is not run again.  Work and space per batch grow with the change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PARTS = 32  # of a tenant's rows, at most, that are written side by side


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class SnapshotLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _commit(self, version: int) -> str:
        return f"{self.root}/commits/b{version}"

    def committed(self, version: int) -> bool:
        return path_exists(self.spark, f"{self._commit(version)}/_SUCCESS")

    def start(self, initial: DataFrame) -> None:
        """Version -1: the rows before the first batch; does nothing when it is there."""
        if not self.committed(-1):
            self.publish(-1, initial)

    def manifest(self, version: int) -> DataFrame:
        return self.spark.read.schema("tenant_id string, attempt string").parquet(self._commit(version))

    def read(self, version: int, tenants: DataFrame | None = None) -> DataFrame:
        """The rows of a version, of all tenants or of those in ``tenants`` (tenant_id)."""
        names = self.manifest(version)
        if tenants is not None:
            names = names.join(tenants.select("tenant_id").distinct(), "tenant_id", "left_semi")
        attempts = [r[0] for r in names.select("attempt").distinct().collect()]  # at most one per batch
        every = self.spark.read.schema(self._schema()).option("basePath", f"{self.root}/data")
        rows = every.parquet(*[f"{self.root}/data/attempt={a}" for a in attempts]) if attempts else self.spark.createDataFrame([], self._schema())
        return rows.join(names, ["attempt", "tenant_id"], "left_semi").drop("attempt")

    def _schema(self):
        from pyspark.sql import types as T

        rows = T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/schema").first()[0]))
        return T.StructType([*rows.fields, T.StructField("attempt", T.StringType())])

    def publish(self, version: int, rows: DataFrame, outcomes: DataFrame | None = None,
                before_commit: Callable[[], None] | None = None) -> None:
        """Write ``rows`` (whole tenants) as the newest state of their tenants, then commit."""
        attempt = f"{max(version, 0)}-{uuid.uuid4().hex[:12]}"
        folder = f"{self.root}/data/attempt={attempt}"
        if version < 0:
            self.spark.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/schema")
        part = F.pmod(F.xxhash64("user_id", "namespace"), F.lit(PARTS))  # a busy tenant's rows are written by several tasks
        rows.repartition("tenant_id", part).sortWithinPartitions("user_id", "namespace").write.partitionBy("tenant_id").parquet(folder)
        if outcomes is not None:
            outcomes.write.parquet(f"{self.root}/outcomes/{attempt}")
        if before_commit:
            before_commit()
        written = self.spark.read.schema("tenant_id string").parquet(folder)  # the folders' names: no row is read or made again
        new = written.distinct().withColumn("attempt", F.lit(attempt))
        if version >= 0:
            new = new.unionByName(self.manifest(version - 1).join(new.select("tenant_id"), "tenant_id", "left_anti"))
            self.spark.createDataFrame([(version, attempt)], "version int, attempt string").coalesce(1).write.mode("overwrite").parquet(
                f"{self.root}/outcome_names/b{version}")
        new.write.mode("overwrite").parquet(self._commit(version))

    def newest(self) -> int:
        """The highest committed version (they are without gaps)."""
        version = -1
        while self.committed(version + 1):
            version += 1
        return version

    def outcomes(self) -> DataFrame:
        """The outcomes of all committed batches."""
        names = [self.spark.read.parquet(f"{self.root}/outcome_names/b{k}").first()["attempt"] for k in range(self.newest() + 1)]
        return self.spark.read.parquet(*[f"{self.root}/outcomes/{a}" for a in names])


def gated_store_stream(requests: DataFrame, log: SnapshotLog, tenants: DataFrame, members: DataFrame, teams: DataFrame, as_of,
                       checkpoint: str, uuid_pattern: str | None = None, before_commit: Callable[[], None] | None = None):
    """ST1 with all gates: each micro-batch of requests (in their order) is validated, gated
    and stored (``store_path``) against the version before it.  Only the batch's tenants are
    read, and only those that it changes are written."""
    from engram.operators import store_path as P
    from engram.session import ensure_checkpoint_dir, stored
    from engram.sources.commands import UUID_PATTERN

    ensure_checkpoint_dir(log.spark)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if log.committed(batch_id):
            return
        batch = stored(batch)
        memories = log.read(batch_id - 1, batch)  # files that stay: each use reads the columns that it needs
        outcomes, accepted = P.store_requests(batch, memories, tenants, members, teams, uuid_pattern or UUID_PATTERN)
        changed = outcomes.filter("action in ('stored', 'replaced')").select("tenant_id").distinct()
        new = P.next_snapshot(memories, accepted, outcomes, as_of).join(changed, "tenant_id", "left_semi")
        log.publish(batch_id, new, outcomes, before_commit)

    return requests.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
