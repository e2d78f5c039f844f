"""Unique keys under claims and releases, in command order (C5 for updates).

An owner holds at most one key of its scope.  A claim succeeds unless another
owner of the scope holds the key at that moment; it releases the key that the
owner held before, for later claims of others.

Keys that only one owner ever holds or claims are calm: their claims always
succeed.  The other keys tie owners together; each connected component of
owners and contested keys is walked in command order with the calm claims of
its owners, which release keys.  Components are found in logarithmic rounds,
and only they are walked serially: the state is one key per owner.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.components import connected_components
from engram.session import ship_package, stored


def _walk(pdf: pd.DataFrame, order: list[str]) -> pd.DataFrame:
    """Claims of a component in order (holders have no order and come first)."""
    pdf = pdf.sort_values(order, na_position="first", kind="stable")
    holder: dict[tuple, str] = {}
    held: dict[tuple, str] = {}
    ok = []
    for scope, owner, key in zip(pdf["scope"], pdf["owner"], pdf["key"]):
        by = holder.get((scope, key))
        if by is None:
            before = held.get((scope, owner))
            if before is not None:
                del holder[scope, before]
            held[scope, owner] = key
            holder[scope, key] = owner
        ok.append(by is None or by == owner)
    out = pd.DataFrame({"cmd_id": pdf["cmd_id"], "granted": ok})
    return out[out["cmd_id"].notna()]


def claim_keys(claims: DataFrame, holders: DataFrame | None = None, order: tuple[str, ...] = ("cmd_id",)) -> DataFrame:
    """claims(cmd_id, scope, owner, key and the columns of ``order``), holders(scope, owner,
    key) -> (cmd_id, granted).  Nulls claim nothing and are not granted."""
    spark = claims.sparkSession
    ship_package(spark)
    cols, extra = ["scope", "owner", "key"], [c for c in order if c != "cmd_id"]
    kind = dict(claims.dtypes)["cmd_id"]
    claims = claims.select("cmd_id", *cols, *extra)
    every = claims.dropna(subset=cols)
    if holders is not None:
        every = every.unionByName(holders.select(*cols).dropna(subset=cols), allowMissingColumns=True)
    every = stored(every)
    touched = every.select(*cols).distinct()
    contested = touched.groupBy("scope", "key").agg(F.count("*").alias("n")).filter("n > 1").select("scope", "key")
    ties = touched.join(contested, ["scope", "key"]).select(
        F.xxhash64("scope", F.lit("owner"), "owner").alias("a"), F.xxhash64("scope", F.lit("key"), "key").alias("b"))
    comps = connected_components(ties, stored).select(F.col("node").alias("_node"), "component")
    # contested claims and the other claims of the same owners; small components share a task
    rows = every.withColumn("_node", F.xxhash64("scope", F.lit("owner"), "owner")).join(comps, "_node").drop("_node")
    names = list(order)
    bucket = F.pmod("component", F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([_walk(g, names) for _, g in pdf.groupby("component", sort=False)], ignore_index=True)

    walked = rows.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(walk, f"cmd_id {kind}, granted boolean")
    named = F.coalesce(F.col("granted"), F.col("scope").isNotNull() & F.col("owner").isNotNull() & F.col("key").isNotNull())
    return claims.join(walked, "cmd_id", "left").select("cmd_id", named.alias("granted"))
