"""The edge rows that every operator must survive, and the small test tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} x{i * 7919 % 10007}" for i in range(20000))
PASSAGE = " ".join(f"pass{i}age" for i in range(60))
EDGE = [
    (9001, None, None, None), (9002, "", "en", "s"), (9003, " \n\t ", "en", None), (9004, "one two", "en", "s"), (9005, "One  TWO\n", "en", "s"),
    (9006, LONG, "en", "s"), (9006, LONG, "en", "s"), (9007, LONG + " tail", None, "s"), (None, "no id here at all, sir", "en", "s"),
    (9008, "before it\n" + PASSAGE + "\nafter it", "en", "s"), (9009, "other start\nand more\n" + PASSAGE, "en", "s"),
    (9010, "née Ünï <|endoftext|> 日本 語 \u00a0 x\u2003y  z ſK", "fr", "t"),
]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) of the small table and the edge rows."""
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall() + [r[:2] for r in EDGE]


@pytest.fixture(scope="session")
def docs(spark):
    """The small documents with edge rows and columns whose names operators use themselves."""
    edge = spark.createDataFrame([(*r, len(r[1] or "")) for r in EDGE], "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.read.parquet(f"{SF}/documents.parquet").unionByName(edge)
    names = ("tok", "node", "label", "a", "b", "n", "g", "x", "_part", "_id", "_td", "key", "shard", "length", "score", "hits", "w", "size")
    from pyspark.sql import functions as F

    return table.select("*", *(F.lit("clash").alias(c) for c in names)).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
