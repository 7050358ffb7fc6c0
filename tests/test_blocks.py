import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.operators import blocks, bm25
from quarry.plans import ingest as ingest_plan
from quarry.plans import search
from quarry.session import shared_dir
from quarry.sources import corpus as corpus_src
from quarry.sources.testdata import LANG_DOMAINS, REQUEST_DOMAINS, SourceTables
from quarry.sources.domains import catalog
from tests.conftest import SF_MID, SF_SMALL


@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 5)), min_size=1, max_size=30), st.integers(1, 6))
def test_ranges_hold_all_and_are_few(spans, most):
    starts = np.array([a for a, _ in spans])
    got = blocks.ranges_of(starts, starts + np.array([n for _, n in spans]), most)
    assert len(got) <= max(1, most) and all(any(x <= a and a + n <= y for x, y in got) for a, n in spans)
    assert all(y < x2 for (_, y), (x2, _) in zip(got, got[1:]))


@pytest.fixture(scope="module")
def stored(spark):
    t = SourceTables(spark, SF_MID)
    root = shared_dir(spark, "collection")
    coll = t.collection()
    ingest_plan.write_collection(coll, root)
    return t, coll, ingest_plan.read_collection(spark, root)


def test_stored_index_gives_the_same_top_k(spark, stored):
    t, coll, read = stored
    want = sorted(map(tuple, bm25.bm25_topk(t.questions(), coll.index).collect()))
    assert sorted(map(tuple, bm25.bm25_topk(t.questions(), read.index).collect())) == want
    assert sorted(map(tuple, read.index.postings.collect())) == sorted(map(tuple, coll.index.postings.select(*read.index.postings.columns).collect()))


def test_skipping_reads_few_blocks(spark):
    """Ten copies of the corpus with words of their own: a batch reads under a fifth of the postings."""
    t = SourceTables(spark, SF_MID)
    c = t.corpus()
    n = c.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    ten = c.join(F.broadcast(n), "domain").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    ten = ten.withColumn("chunk_pos", F.col("chunk_pos") + F.col("copy") * F.col("n")).withColumn(
        "content", F.when(F.col("copy") == 0, F.col("content")).otherwise(F.concat(F.col("content"), F.lit(" copy"), F.col("copy").cast("string"))))
    root = shared_dir(spark, "collection")
    index = bm25.build_index(ten.drop("n", "copy"))
    index.write(root)
    read = bm25.BM25Index.read(spark, root)
    qs = corpus_src.questions_for_domains(t.table("benchmark").limit(40), "item_id", "text", REQUEST_DOMAINS)
    got = sorted(map(tuple, bm25.bm25_topk(qs, read).collect()))
    assert got == sorted(map(tuple, bm25.bm25_topk(qs, index).collect()))
    total = read.stored.rows.agg(F.sum("n")).first()[0]
    used = sum(df.agg(F.sum("n")).first()[0] or 0 for df in read.stored.scans)
    assert 0 < used < 0.2 * total, (used, total)
    # the keys reach the Parquet reader
    plan = read.stored.scans[0]._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(head" in plan and "PartitionFilters: [" in plan


def test_many_keys_fall_back_to_ranges_and_no_filter(spark, stored, monkeypatch):
    t, coll, read = stored
    qs = t.questions().where("question_id < 6")
    want = sorted(map(tuple, bm25.bm25_topk(qs, coll.index).collect()))
    for name, value in (("KEYS", 3), ("SCANS", 1), ("MAX_KEYS", 5), ("LEFT_OUT", 0.0), ("LEFT_OUT", 0.9)):
        with monkeypatch.context() as m:
            m.setattr(blocks, name, value)
            assert sorted(map(tuple, bm25.bm25_topk(qs, read.index).collect())) == want, name


def test_negative_eps_small_domains_and_nulls(spark):
    rows = [("a", 0, "x y"), ("a", 1, "x y"), ("a", 2, "x"), ("b", 0, "x"), ("c", 0, ""), ("c", 1, "q q q z")]
    df = spark.createDataFrame(rows, "domain string, chunk_pos long, content string")
    qs = spark.createDataFrame([(1, d, "x y nothing q q") for d in "abcd"], "question_id long, domain string, question string")
    index = bm25.build_index(df)
    root = shared_dir(spark, "collection")
    index.write(root)
    read = bm25.BM25Index.read(spark, root)
    assert index.stats.where("eps < 0").count() > 0
    for k in (1, 2, 10):
        assert sorted(map(tuple, bm25.bm25_topk(qs, read, k).collect())) == sorted(map(tuple, bm25.bm25_topk(qs, index, k).collect()))
