"""S8 counts trigrams where their text is: only bucket counts are shuffled."""

from __future__ import annotations

import hashlib
from collections import Counter

from engram.sources import embedding as EMB


def test_counts_with_edge_texts(spark, monkeypatch):
    texts = [(1, "abcabc"), (2, "ab"), (3, None), (4, ""), (5, "\U0001F600\U0001F600é漢"), (6, "xyz" * 50), (7, "a"), (8, "\x00ab"), (1, "abcd"), (None, "abc")]
    want = Counter()
    for k, t in texts:
        for i in range(len(t or "") - 2):
            want[k, int(hashlib.md5(t[i:i + 3].encode()).hexdigest()[:8], 16) % 16] += 1
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for parts in (1, 3):
        got = EMB.trigram_buckets(df.coalesce(1) if parts == 1 else df.repartition(parts), "text", 16).collect()
        assert {(r["doc_id"], r["bucket"]): r["cnt"] for r in got} == want


def test_texts_do_not_run_together():
    row, bucket, cnt = EMB._bucket_counts(["abc", "defg", "hij"], 7, {})
    per = Counter()
    for r, _, c in zip(row.tolist(), bucket.tolist(), cnt.tolist()):
        per[r] += c
    assert per == {0: 1, 1: 2, 2: 1}


def test_no_row_per_trigram(spark):
    df = spark.createDataFrame([(1, "abcdefgh" * 10)], "doc_id long, text string")
    plan = EMB.trigram_buckets(df, "text", 16)._jdf.queryExecution().toString()
    assert "Generate" not in plan
