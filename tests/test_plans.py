"""Plan shape: top-k pushdown, no cross products, pruned scans, shuffle-free scoring."""

from quarry.operators import bm25
from quarry.plans import ingest as ingest_plan
from quarry.plans import search
from quarry.session import shared_dir
from quarry.sources.testdata import SourceTables
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_uses_window_group_limit(spark):
    t = SourceTables(spark, SF_SMALL)
    p = _plan(bm25.bm25_topk(t.questions(), bm25.build_index(t.corpus())))
    assert "WindowGroupLimit" in p


def test_hybrid_has_no_cross_product(spark):
    t = SourceTables(spark, SF_SMALL)
    p = _plan(search.hybrid_search(t.questions(), t.collection()))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scores_need_no_shuffle_after_postings(spark):
    t = SourceTables(spark, SF_SMALL)
    coll = t.collection()
    s = bm25.scores(t.questions(), coll.index)
    s.count()
    p = s._jdf.queryExecution().executedPlan().toString()
    # the aggregate of the matched side sits directly over the union of the postings probe
    agg_part = p.split("Union")[0]
    assert "Exchange hashpartitioning(question_id" not in agg_part


def test_domain_scan_is_partition_pruned(spark):
    t = SourceTables(spark, SF_SMALL)
    root = shared_dir(spark, "collection")
    ingest_plan.write_collection(search.build_collection(t.corpus()), root)
    df = ingest_plan.read_collection(spark, root, ["fr"]).chunks
    p = _plan(df)
    assert "PartitionFilters: [isnotnull(domain" in p and "fr" in p


def test_projection_reaches_scan(spark):
    t = SourceTables(spark, SF_SMALL)
    p = _plan(t.query_log().groupBy("domain").count())
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string" in p or "ReadSchema: struct<event_type" in p
    assert "text" not in p.split("ReadSchema")[1].split("\n")[0]
