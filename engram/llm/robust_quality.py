"""Quality rules with robust multivariate outliers.

Base statistics of a text give the fixed rules.  The documents that pass them
are described by a vector of transformed statistics; for each language and
source, location and scatter are estimated by minimum covariance determinant: a
start from medians and median deviations, then concentration steps, each of
which re-estimates mean and covariance on the share ``CORE`` of rows with the
least Mahalanobis distance, and a last reweighted step.  A document is rejected
when its squared distance exceeds ``CUTOFF``.  All rows of a group count: sums and quantile sketches are
pre-aggregated per task, so a group that holds a third of all rows is no hot
spot, and only one row of estimates per group is inverted.  Groups of fewer than
``MIN_GROUP`` documents use their language's estimate, languages of fewer the
estimate over all.

Edge cases: null, empty or blank texts have 0 words and fail; null languages and
sources are groups of their own; an empty table gives an empty result; constant
statistics get a floor of variance; repeated rows count each; extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, U64, map_batches, materialise, mix, span_hashes, word_spans

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
CORE = 0.75
STEPS = 3
MIN_GROUP = 200
CUTOFF = 150.0
LEVELS = ("source", "lang", "all")
DIMS = 4
BROADCAST_GROUPS = 10_000  # estimates of up to this many groups (3 MB) are broadcast
FLOOR = (0.15, 0.12, 0.06, 0.06)  # least standard deviations of the statistics
_BASE = {"doc_id": "long", "lang": "string", "source": "string", "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    code = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(code, np.uint8)
    starts, ends = word_spans(raw, SPACES)
    n = len(starts)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = len(code) - len(code.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in code.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if n >= 3:
        h = span_hashes(raw, starts, ends)
        three = mix(mix(h[:-2] * U64(0x9E3779B97F4A7C15) + h[1:-1]) * U64(0xC2B2AE3D27D4EB4F) + h[2:])
        order = np.argsort(three, kind="stable")
        same = three[order][1:] == three[order][:-1]
        again = np.zeros(n - 2, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= again
        repeat = int(cover.sum())
    return n, chars, symbols, dup, repeat


def statistics(docs: DataFrame) -> DataFrame:
    """The base counts of every row, with doc_id, lang and source."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        counts = list(zip(*map(base_counts, cols["text"]))) or [()] * 5
        return {k: cols[k] for k in ("doc_id", "lang", "source")} | dict(zip(list(_BASE)[3:], map(list, counts)))

    stats = map_batches(docs.select("doc_id", "lang", "source", "text"), _BASE, rows)
    return stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list:
    """The transformed statistics as columns: word length, symbols, repeated lines and
    repeated words, each on a scale on which ordinary texts vary little."""
    n = F.greatest("n_words", F.lit(1))
    return [
        F.log(F.col("word_chars") / n), F.log1p(100.0 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n),
    ]


def _group(level: int):
    """The key of a row's group at a level of LEVELS (0 is the finest)."""
    lang = F.coalesce(F.concat(F.lit("l"), "lang"), F.lit("-"))
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    return (F.concat_ws("\x00", lang, source), lang, F.lit(""))[level]


def _solve(params: DataFrame) -> DataFrame:
    """Invert each group's covariance, with the floor of variance added."""
    floor = np.diag(np.square(FLOOR))

    def run(frames):
        for frame in frames:
            inverse = [np.linalg.inv(np.array(c, np.float64).reshape(DIMS, DIMS) + floor).ravel().tolist() for c in frame["cov"]]
            yield pd.DataFrame({"g": frame["g"], "mean": [[float(y) for y in x] for x in frame["mean"]], "inverse": inverse})

    return params.select("g", "mean", "cov").mapInPandas(run, "g string, mean array<double>, inverse array<double>")


def _beside(rows: DataFrame, small: DataFrame, groups: int, how: str = "inner") -> DataFrame:
    """Join one row per group to ``rows``: by broadcast when there are few groups, so that
    a large group's rows stay where they are; else by shuffle."""
    return rows.join(F.broadcast(small) if groups <= BROADCAST_GROUPS else small, "g", how)


def _distance():
    gap = [F.col("x")[i] - F.col("mean")[i] for i in range(DIMS)]
    return sum((F.col("inverse")[i * DIMS + j] * gap[i] * gap[j] for i in range(DIMS) for j in range(DIMS)), F.lit(0.0))


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance of the rows of each group, from sums taken about the last
    mean, which keeps them exact where a statistic is nearly constant."""
    gap = [F.col("x")[i] - F.col("mean")[i] for i in range(DIMS)]
    pairs = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
    sums = rows.groupBy("g").agg(
        F.first("mean").alias("mean"), *(F.avg(gap[i]).alias(f"m{i}") for i in range(DIMS)), *(F.avg(gap[i] * gap[j]).alias(f"c{i}{j}") for i, j in pairs)
    )
    cov = [F.col(f"c{min(i, j)}{max(i, j)}") - F.col(f"m{i}") * F.col(f"m{j}") for i in range(DIMS) for j in range(DIMS)]
    return sums.select("g", F.array(*(F.col("mean")[i] + F.col(f"m{i}") for i in range(DIMS))).alias("mean"), F.array(*cov).alias("cov"))


def estimates(rows: DataFrame) -> DataFrame:
    """(g, mean, inverse) of every group of ``rows`` (g, x)."""
    groups = rows.select("g").distinct().count()
    middle = rows.groupBy("g").agg(*(F.percentile_approx(F.col("x")[i], 0.5, 10_000).alias(f"m{i}") for i in range(DIMS)))
    middle = middle.select("g", F.array(*(f"m{i}" for i in range(DIMS))).alias("mean"))
    spread = _beside(rows, middle, groups).groupBy("g").agg(
        F.first("mean").alias("mean"), *(F.percentile_approx(F.abs(F.col("x")[i] - F.col("mean")[i]), 0.5, 10_000).alias(f"s{i}") for i in range(DIMS))
    )
    diagonal = [F.pow(1.4826 * F.col(f"s{i}"), 2) if i == j else F.lit(0.0) for i in range(DIMS) for j in range(DIMS)]
    params = materialise(_solve(spread.select("g", "mean", F.array(*diagonal).alias("cov"))))
    for step in range(STEPS + 1):
        far = _beside(rows, params, groups).withColumn("d", _distance())
        # the core of each step; at the end all rows at an ordinary distance
        near = far.groupBy("g").agg(F.percentile_approx("d", CORE, 10_000).alias("cut"))
        if step == STEPS:
            near = near.withColumn("cut", F.greatest("cut", F.lit(20.0)))
        core = _beside(far, near, groups).filter("d <= cut")
        params = materialise(_solve(_moments(core)))
    return params


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every row, and its distance."""
    stats = materialise(statistics(docs).withColumn("x", F.array(*(F.coalesce(v, F.lit(0.0)) for v in vector()))))
    good = stats.filter(~F.col("base_failed"))
    sizes = [good.groupBy(_group(k).alias("g")).agg(F.count("*").alias("n")).filter(F.col("n") >= (MIN_GROUP if k < 2 else 0)) for k in range(3)]
    marked = stats
    for k in range(2):
        marked = marked.withColumn(f"g{k}", _group(k)).join(sizes[k].select(F.col("g").alias(f"g{k}"), F.lit(True).alias(f"h{k}")), f"g{k}", "left")
    marked = marked.withColumn("g", F.when(F.col("h0"), F.concat(F.lit("0"), "g0")).when(F.col("h1"), F.concat(F.lit("1"), "g1")).otherwise(F.lit("2")))
    marked = materialise(marked.drop("g0", "g1", "h0", "h1"))
    # every level is estimated on all rows of its groups, for whichever rows need it
    every = None
    for k in range(3):
        rows = marked.filter("not base_failed").select(F.concat(F.lit(str(k)), _group(k)).alias("g"), "x")
        wanted = marked.select("g").filter(F.col("g").startswith(str(k))).distinct()
        rows = rows.join(wanted, "g", "left_semi")
        every = rows if every is None else every.unionByName(rows)
    params = estimates(materialise(every))
    judged = _beside(marked, params, params.count(), "left").withColumn("distance", _distance())
    return judged.select(
        "doc_id", *list(_BASE)[3:], "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"), "distance"
    )
