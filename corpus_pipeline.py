"""Documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes its result as
Parquet under ``spark.checkpoint.dir`` and reads it again as the next one's
documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm import decontam, line_chunks, packing, parity_join, toxicity
from engram.llm.common import materialise


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row as one column: none of its names can meet a stage's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _named(docs: DataFrame) -> DataFrame:
    return _carried(docs).select("doc_id", F.unhex(F.md5("text")).alias("_t"), "row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose toxicity score is below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, ~toxicity.held_out())
    return toxicity.score(_carried(docs), model, ("row",)).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that occur elsewhere before; documents stay, if need be empty."""
    done = line_chunks.edit_rows(docs)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars"))
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id (then text digest; null ids last) of each group
    of near duplicates."""
    groups = materialise(parity_join.near_duplicates(docs.select("doc_id", "text")))
    # groups go by the number of their component: ids may be null, or shared by different texts
    place = F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("td").alias("t"))
    first = groups.filter("n_shingles > 0").groupBy("component").agg(F.min(place).alias("p"))
    leads = first.select(F.col("p.d").alias("_d"), F.col("p.t").alias("_td"), F.lit(True).alias("_words"), F.col("component").alias("_c"))
    # a document without words stays; equal rows of a lead stay once
    blank = groups.filter("n_shingles = 0").select(F.col("doc_id").alias("_d"), F.col("td").alias("_td"), F.lit(False).alias("_words"), F.col("component").alias("_c")).distinct()
    kept = _named(docs).join(leads.unionByName(blank), F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_t").eqNullSafe(F.col("_td")))
    words = kept.filter("_words").dropDuplicates(["_c"])
    return words.unionByName(kept.filter("not _words")).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents without a window of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontam.find_leaks(docs.select("doc_id", "text"), benchmark).filter(F.size("hits") > 0)
    bad = leaks.select(F.col("doc_id").alias("_d"), F.col("td").alias("_td")).distinct()
    return _named(docs).join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_t").eqNullSafe(F.col("_td")), "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None  # the stages train, sketch and pack: tested against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
