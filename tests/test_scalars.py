"""Golden values from the service's documentation and edge rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from engram.functions import scalars as S


def _one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()["x"]


def test_blend_goldens(spark):
    assert _one(spark, S.round4(S.blend("s", "d")), s=0.8921, d=0.95) == 0.9095
    assert _one(spark, S.round4(S.blend("s", "d")), s=0.8832, d=0.9704) == 0.9094


def test_decay_curve(spark):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    for strength, days, expected in [(0.2, 1, 0.61), (0.2, 3, 0.22), (0.2, 7, 0.03),
                                     (1.0, 1, 0.90), (1.0, 7, 0.50), (1.0, 30, 0.05)]:
        created = F.expr(f"timestampadd(DAY, -{days}, TIMESTAMP_NTZ'2024-01-31 00:00:00')")
        got = _one(spark, S.decay(created, F.col("imp"), as_of), imp=strength)
        assert round(got, 2) == expected, (strength, days, got)


def test_decay_floor_and_future(spark):
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    created = F.expr("timestampadd(DAY, -1, TIMESTAMP_NTZ'2024-01-31 00:00:00')")
    # importance 0 uses the 0.1 floor: strength 1 day
    assert math.isclose(_one(spark, S.decay(created, F.col("imp"), as_of), imp=0.0), math.exp(-1))
    future = F.expr("timestampadd(DAY, 1, TIMESTAMP_NTZ'2024-01-31 00:00:00')")
    assert _one(spark, S.decay(future, F.col("imp"), as_of), imp=1.0) > 1.0


def test_js_number_and_iso(spark):
    assert _one(spark, S.js_number(F.col("x")), x=1.0) == "1"
    assert _one(spark, S.js_number(F.col("x")), x=0.95) == "0.95"
    assert _one(spark, S.js_number(F.col("x")), x=0.0) == "0"
    assert _one(spark, S.js_number(F.col("x")), x=0.0001) == "0.0001"
    ts = F.lit("2024-01-02 03:04:05.678").cast("timestamp_ntz")
    assert _one(spark, S.iso_ms(ts)) == "2024-01-02T03:04:05.678Z"


def test_limits_flags_emails(spark):
    assert _one(spark, S.clamp_limit(F.col("x"), "search"), x="80") == 50
    assert _one(spark, S.clamp_limit(F.col("x"), "search"), x="abc") is None
    assert _one(spark, S.clamp_limit(F.lit(None).cast("string"), "context")) == 5
    assert _one(spark, S.clamp_limit(F.col("x"), "list"), x="-1") is None
    assert _one(spark, S.flag(F.col("x")), x="1") is True
    assert _one(spark, S.flag(F.col("x")), x="yes") is False
    assert _one(spark, S.norm_email(F.col("x")), x="  Ann@Mail.COM ") == "ann@mail.com"
    assert _one(spark, S.name_from_email(F.col("x")), x="ann@mail.com") == "ann"
    assert _one(spark, S.effective_visibility(F.col("t"), F.col("v")), t="x", v="private") == "team"


def test_usage_golden(spark):
    from engram.operators.usage import remaining

    assert _one(spark, remaining(F.col("l"), F.col("u"), clamp=True), l=1000, u=342) == 658
    assert _one(spark, remaining(F.col("l"), F.col("u"), clamp=True), l=10, u=342) == 0
    assert _one(spark, remaining(F.col("l"), F.col("u"), clamp=False), l=10, u=342) == -332
