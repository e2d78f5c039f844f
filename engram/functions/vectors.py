"""Vector expressions on ``array<double>`` columns.

Spark 4.1 has no vector functions, so these are higher-order array
expressions evaluated in the JVM.  Norms are computed once per row and
carried as a column so that each candidate pair costs one dot product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.scalars import col_


def as_double(v) -> Column:
    return col_(v).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(col_(a), col_(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col_(v), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a, b, norm_a, norm_b) -> Column:
    """1 - cosine distance.  Null vector -> null; zero norm -> null (the
    service's NaN sorts last; Spark would sort NaN first, so it is mapped
    to null), and so do vectors with a NaN component."""
    denom = col_(norm_a) * col_(norm_b)
    return F.when((denom > 0) & ~F.isnan(denom), dot(a, b) / denom)


def lin_comb(a, b, wa: float, wb: float) -> Column:
    """wa * a + wb * b elementwise."""
    return F.zip_with(col_(a), col_(b), lambda x, y: x * F.lit(wa) + y * F.lit(wb))


def with_norm(df, vec: str = "embedding", out: str = "norm"):
    """Cast the vector to double and attach its norm (once per row)."""
    return df.withColumn(vec, as_double(vec)).withColumn(out, norm(vec))
