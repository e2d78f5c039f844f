"""Plan shape: the properties the operators are designed for."""

from __future__ import annotations

from conftest import SF_MID

from engram.operators import retrieval as R
from engram.sources import fixtures as FX


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_team_scope_is_an_equi_join(spark):
    q = FX.queries_fx(spark, SF_MID, "team")
    df = R.search(q, FX.memories_fx(spark, SF_MID), FX.as_of_col(), FX.team_members_fx(spark, SF_MID),
                  FX.teams_fx(spark, SF_MID))
    plan = _plan(df)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_recent_never_reads_vectors(spark):
    df = R.recent(FX.queries_fx(spark, SF_MID).drop("vector"), FX.memories_fx(spark, SF_MID),
                  FX.as_of_col(), max_limit=3)
    scans = [ln for ln in df._jdf.queryExecution().executedPlan().toString().splitlines()
             if "FileScan" in ln or "Scan parquet" in ln]
    assert scans
    mem_scans = [s for s in scans if "embeddings" in s and "doc_id" not in s]
    for s in mem_scans:
        assert "embedding" not in s.split("ReadSchema")[-1]


def test_candidates_use_window_group_limit(spark):
    q = FX.queries_fx(spark, SF_MID)
    df = R.search(q, FX.memories_fx(spark, SF_MID), FX.as_of_col(), max_limit=3)
    assert "WindowGroupLimit" in _plan(df)
