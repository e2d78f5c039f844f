"""The stored list index: only probed partitions are read, appended rows are found."""

from __future__ import annotations

import io
import tempfile
from contextlib import redirect_stdout

from conftest import SF_SMALL
from engram.operators import ann
from engram.operators import retrieval as R
from engram.sources import fixtures as FX


def test_index_prunes_and_grows(spark):
    root = tempfile.mkdtemp(prefix="engram-ivf-") + "/index"
    mem, members, teams = FX.memories_fx(spark, SF_SMALL), FX.team_members_fx(spark, SF_SMALL), FX.teams_fx(spark, SF_SMALL)
    first, rest = mem.filter("substring(id, 2) % 2 = 0"), mem.filter("substring(id, 2) % 2 = 1")
    ann.build_index(first, ann.kmeans_centroids(mem, 12), root)
    q = R.gate_queries(FX.queries_fx(spark, SF_SMALL), members, teams, "search")
    probed = ann.probe_lists(q.limit(1), root, 2)
    assert probed.count() == 2
    rows = ann.probed_rows(probed, root)
    shown = io.StringIO()
    with redirect_stdout(shown):
        rows.explain("formatted")
    wanted = {r["q_cid"] for r in probed.collect()}
    filters = next(x for x in shown.getvalue().splitlines() if "PartitionFilters" in x)
    assert "cid" in filters and all(str(c) in filters for c in wanted)
    read = {r[0].split("cid=")[1].split("/")[0] for r in rows.selectExpr("input_file_name()").distinct().collect()}
    assert read <= {str(c) for c in wanted}
    # every list probed: the exact answer, over what the index holds
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "id", "score").collect())
    args = (FX.as_of_col(),)
    assert key(ann.ivf_search(FX.queries_fx(spark, SF_SMALL), root, *args, 12, members, teams)) == key(
        R.search(FX.queries_fx(spark, SF_SMALL), first, *args, members, teams))
    ann.extend_index(rest, root)
    assert key(ann.ivf_search(FX.queries_fx(spark, SF_SMALL), root, *args, 12, members, teams)) == key(
        R.search(FX.queries_fx(spark, SF_SMALL), mem, *args, members, teams))


def test_vectors_without_a_direction(spark):
    root = tempfile.mkdtemp(prefix="engram-ivf-") + "/index"
    base = FX.memories_fx(spark, SF_SMALL).filter("valid_until is null").limit(4).checkpoint()
    odd = base.limit(1).selectExpr("* except (embedding)", "array(cast(0 as double), 0) embedding").select(base.columns)
    nan = base.limit(1).selectExpr("* except (embedding)", "cast(null as array<double>) embedding").select(base.columns)
    cents = spark.createDataFrame([(0, [1.0] + [0.0] * 63), (1, [0.0, 1.0] + [0.0] * 62)], "cid int, centroid array<double>")
    ann.build_index(base.unionByName(odd).unionByName(nan), cents, root)
    lists = {r["cid"]: r["count"] for r in spark.read.parquet(f"{root}/lists").groupBy("cid").count().collect()}
    assert lists[-1] == 2 and sum(lists.values()) == 6
