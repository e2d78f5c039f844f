"""Request bodies (JSON) -> typed command tables, with the service's
required fields, defaults and validation rules (C1).  Extra fields are
ignored; malformed JSON lands in a ``parse_error`` row instead of failing
the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.scalars import col_

UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"

STORE_SCHEMA = ("struct<user_id:string, fact:string, importance:double, source:string, namespace:string, "
                "team_id:string, visibility:string>")


def parse_commands(raw: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Parse JSON bodies with a fixed schema (no inference).  Rows whose body
    is not a JSON object get ``parse_error`` = true and null fields."""
    parsed = F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"})
    valid_json = F.get_json_object(F.col(body), "$").isNotNull() & F.trim(F.col(body)).startswith("{")
    out = raw.withColumn("_c", F.when(valid_json, parsed)).withColumn("parse_error", ~valid_json)
    return out.select(*[c for c in raw.columns if c != body], "parse_error", "_c.*")


def with_store_defaults(cmds: DataFrame) -> DataFrame:
    """importance 0.5, source 'api', namespace 'default' when omitted."""
    return (cmds.withColumn("importance", F.coalesce("importance", F.lit(0.5)))
            .withColumn("source", F.coalesce("source", F.lit("api")))
            .withColumn("namespace", F.coalesce("namespace", F.lit("default"))))


def memory_reasons(df: DataFrame, uuid_pattern: str = UUID_PATTERN) -> Column:
    """C1 as an array of failed rules (empty = valid): user_id >= 1 char;
    fact 1..2000; importance 0..1; source <= 50; namespace <= 100;
    visibility private|team; team_id in uuid format."""
    def rule(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    u, f = col_("user_id"), col_("fact")
    return F.array_compact(F.array(
        rule(u.isNull() | (F.length(u) < 1), "user_id"),
        rule(f.isNull() | (F.length(f) < 1) | (F.length(f) > 2000), "fact"),
        rule(col_("importance").isNotNull() & ((col_("importance") < 0) | (col_("importance") > 1)), "importance"),
        rule(col_("source").isNotNull() & (F.length("source") > 50), "source"),
        rule(col_("namespace").isNotNull() & (F.length("namespace") > 100), "namespace"),
        rule(col_("visibility").isNotNull() & ~col_("visibility").isin("private", "team"), "visibility"),
        rule(col_("team_id").isNotNull() & ~col_("team_id").rlike(uuid_pattern), "team_id"),
    ))


def validate_memory(cmds: DataFrame) -> DataFrame:
    """Adds ``reasons`` (array) and ``accepted``; split with filter."""
    return cmds.withColumn("reasons", memory_reasons(cmds)).withColumn(
        "accepted", F.size("reasons") == 0)


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values held by more than one row (partial counts are combined
    map-side, so a hot key costs one row per task)."""
    return (df.filter(F.greatest(*[F.col(k).isNotNull() for k in keys]) if len(keys) > 1
                      else F.col(keys[0]).isNotNull())
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """C5 enforcement: keep the first row per key (by ``order``)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
