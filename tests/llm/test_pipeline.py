"""The pipeline's stages against brute force, each on its own input."""

from __future__ import annotations

from collections import Counter

from llm.conftest import SF

import corpus_pipeline as P
from llm.test_operators import brute_components, brute_leaks, brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, docs):
    import duckdb

    items = [(str(i), t) for i, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    now = docs.select(*COLUMNS)
    rows = [tuple(r) for r in now.collect()]
    for name, stage in P.STAGES[:-1]:
        now = P.materialise(stage(spark, now, SF))
        assert now.columns == COLUMNS
        before, rows = rows, [tuple(r) for r in now.collect()]
        pairs, kept = [r[:2] for r in before], [r[:2] for r in rows]
        if name == "toxicity":
            assert not Counter(kept) - Counter(pairs) and len(kept) > 0.7 * len(pairs)
        elif name == "line_dedup":
            assert Counter(kept) == brute_lines(pairs)
            changed = {r[0] for r in rows} - {None}
            assert all(r[4] == len(r[1]) for r in rows if r[0] in changed and r[:2] not in pairs)
        elif name == "ngram_jaccard_join":
            groups = brute_components(pairs)
            want = {c for _, n, c in groups if n and c is not None}
            assert Counter(d for d, t in kept if (t or "").strip()) >= Counter(want)
            after = brute_components(kept)
            assert len([c for _, n, c in after.elements() if n]) == len({c for _, n, c in after if n})
            assert sum(n == 0 for _, n, _ in groups.elements()) >= sum(n == 0 for _, n, _ in after.elements()) > 0
        else:
            assert Counter(kept) == Counter(p for p in pairs if not brute_leaks(p[1], items)[4])
    placed = P.STAGES[-1][1](spark, now, SF).collect()
    assert {r["doc_id"] for r in placed} == {r[0] for r in rows}


def test_run_and_empty(spark, docs):
    assert P.run(spark, SF).count() > 0
    empty = docs.select(*COLUMNS).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_near_duplicates_keep_one_row_per_component(spark):
    """Null ids and one id under several texts: one row stays of each group, whatever its id."""
    text = lambda k, n=30: " ".join(f"g{k}w{i}" for i in range(n))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (None, text(3)), (7, text(4)), (7, text(5)), (7, text(6)), (8, text(6) + " end"), (None, text(4)), (5, text(5, 29)), (None, ""), (7, None)]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = P.drop_near_duplicates(spark, df, SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(
        [(None, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (5, text(5, 29)), (7, text(6)), (None, ""), (7, None)]
    )


TEMPORARY = ("_d", "_t", "_td", "_c", "_words", "_id", "_e", "_later", "row", "td", "score", "n_lines", "n_removed", "u", "p", "e", "k", "key", "pos", "run", "x.y")


def test_clashing_names_keep_their_values(spark):
    """Extra columns named like anything that a stage makes come out as they went in."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select(*COLUMNS)
    docs = base.select("*", *(F.concat(F.lit(f"{c} "), F.col("doc_id")).alias(c) for c in TEMPORARY)).cache()
    want = {r["doc_id"]: tuple(r)[5:] for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        done = stage(spark, docs, SF)
        assert done.columns == docs.columns, name
        rows = done.collect()
        assert rows and all(tuple(r)[5:] == want[r["doc_id"]] for r in rows), name
    plain = {(r["doc_id"], r["text"]) for r in P.drop_repeated_lines(spark, base, SF).collect()}
    from engram.llm import line_chunks

    done = line_chunks.remove_repeats(docs)
    assert done.columns == [c for c in docs.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    assert {(r["doc_id"], r["text"]) for r in done.collect()} == plain
    assert all(isinstance(r["n_lines"], int) and r["_td"] == f"_td {r['doc_id']}" for r in done.collect())
