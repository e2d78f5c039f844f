"""Table loading with fixed schemas (no inference) and service defaults.

``load_raw`` reads the shared test tables; ``load_table`` reads a service
table snapshot (memories, tenants, ...) and fills the columns the service
gives defaults for, so older snapshots without a column still load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, I, D, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Raw inputs (the shared parquet tables), read with these schemas.
RAW_SCHEMAS: dict[str, T.StructType] = {
    "embeddings": _schema(("vec_id", L), ("embedding", T.ArrayType(T.FloatType())), ("label", I)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S),
                      ("value", D), ("props", S)),
    "documents": _schema(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "conversations": _schema(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
    "pages": _schema(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _schema(("item_id", L), ("text", S)),
    "labels": _schema(("doc_id", L), ("quality", I), ("toxic", I)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                      ("o_totalprice", D), ("o_orderdate", TS), ("o_orderpriority", S)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                        ("c_mktsegment", S)),
}

# Service tables: (name, type, default or None).  Defaults are the service's
# column defaults; "now" defaults are left null here (callers pass as_of).
SERVICE_TABLES: dict[str, list[tuple]] = {
    "tenants": [("id", S, None), ("name", S, None), ("plan", S, "free"),
                ("memory_limit", L, 10000), ("created_at", TS, None),
                ("stripe_customer_id", S, None), ("email", S, None),
                ("team_limit", L, 1), ("members_per_team_limit", L, 3),
                ("agent_limit", L, 2), ("custom_skill_limit", L, 0)],
    "api_keys": [("id", S, None), ("tenant_id", S, None), ("key_hash", S, None),
                 ("label", S, None), ("created_at", TS, None), ("last_used_at", TS, None)],
    "memories": [("id", S, None), ("tenant_id", S, None), ("user_id", S, None),
                 ("fact", S, None), ("embedding", T.ArrayType(D), None),
                 ("importance", D, 0.5), ("decay_score", D, 1.0), ("access_count", L, 0),
                 ("last_accessed_at", TS, None), ("valid_until", TS, None),
                 ("created_at", TS, None), ("source", S, "api"), ("namespace", S, "default"),
                 ("team_id", S, None), ("visibility", S, "private")],
    "retrieval_logs": [("id", S, None), ("tenant_id", S, None), ("user_id", S, None),
                       ("endpoint", S, None), ("result_count", L, None), ("created_at", TS, None)],
    "feedback": [("id", S, None), ("tenant_id", S, None), ("type", S, None), ("title", S, None),
                 ("description", S, None), ("email", S, None), ("status", S, "new"),
                 ("votes", L, 1), ("metadata", S, "{}"), ("created_at", TS, None)],
    "teams": [("id", S, None), ("tenant_id", S, None), ("name", S, None), ("slug", S, None),
              ("created_at", TS, None)],
    "team_members": [("id", S, None), ("team_id", S, None), ("user_id", S, None),
                     ("email", S, None), ("role", S, "member"), ("invited_by", S, None),
                     ("joined_at", TS, None)],
    "team_invitations": [("id", S, None), ("team_id", S, None), ("email", S, None),
                         ("role", S, "member"), ("token", S, None), ("expires_at", TS, None),
                         ("accepted_at", TS, None), ("created_at", TS, None)],
}


def raw_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in RAW_SCHEMAS:
        reader = reader.schema(RAW_SCHEMAS[name])
    return reader.parquet(raw_path(sf_dir, name))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto a service table's schema, filling defaults for
    missing or null columns (the service's NOT NULL DEFAULT columns)."""
    out = []
    present = set(df.columns)
    for name, dtype, default in SERVICE_TABLES[table]:
        c = F.col(name).cast(dtype) if name in present else F.lit(None).cast(dtype)
        if default is not None:
            c = F.coalesce(c, F.lit(default).cast(dtype))
        out.append(c.alias(name))
    return df.select(*out)


def load_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read a service table snapshot with its fixed schema."""
    return conform(spark.read.parquet(path), table)


def write_snapshot(df: DataFrame, path: str, partition_by: str | None = "tenant_id",
                   mode: str = "errorifexists", touched_only: bool = False) -> str:
    """Write a new, versioned snapshot (never overwrite in place).

    Partitioned by tenant so tenant-scoped reads prune directories; rows are
    sorted within files by the scope keys so row-group statistics prune the
    user/namespace predicates too.  ``touched_only`` (with mode 'overwrite')
    replaces just the partitions that ``df`` has rows of.
    """
    writer = df.sortWithinPartitions(*[c for c in ("tenant_id", "user_id", "namespace")
                                       if c in df.columns]).write.mode(mode)
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    if touched_only:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return path
