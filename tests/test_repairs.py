"""Rows that must not get lost, and plans that must stay cheap."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import answers, bm25, chunking, fusion, sessions, vector
from quarry.plans import ingest as ingest_plan
from quarry.plans import search
from quarry import registry  # noqa: F401
from quarry.plans.conversation import log_records, session_prompts
from quarry.session import shared_dir
from quarry.sources.corpus import load_pages
from quarry.sources.domains import catalog
from quarry.sources.testdata import RESET_EVENT, SourceTables
from tests.conftest import SF_SMALL


@pytest.fixture
def static_overwrite(spark):
    """Spark's default, whatever get_session sets."""
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    yield
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def test_two_step_ingest_keeps_other_domains(spark, static_overwrite):
    t = SourceTables(spark, SF_SMALL)
    root = shared_dir(spark, "two-step")
    for lang in ("en", "fr"):
        one = catalog(spark, [(lang, lang, "d", "c", "l", "s", "t")])
        ingest_plan.ingest(t.pages(), one, root, chunking.chunk_windows).collect()
    coll = ingest_plan.read_collection(spark, root)
    for df in (coll.chunks, coll.vectors, coll.index.postings, coll.index.stats, coll.index.idf):
        assert {r["domain"] for r in df.select("domain").distinct().collect()} == {"en", "fr"}
    hits = bm25.bm25_topk(t.questions().where("domain in ('en', 'fr')"), coll.index).where("score > 0")
    assert {r["domain"] for r in hits.select("domain").distinct().collect()} == {"en", "fr"}


def test_ingest_counts_chunks_before_the_write(spark, monkeypatch):
    t = SourceTables(spark, SF_SMALL)
    lose = bm25.replace_domains
    monkeypatch.setattr(bm25, "replace_domains", lambda df, path, *by: lose(
        df.where("chunk_no = 0") if path.endswith("/chunks") else df, path, *by))
    got = ingest_plan.ingest(t.pages(), t.catalog(), shared_dir(spark, "lossy"), chunking.chunk_windows).collect()
    assert any(r["n_stored"] < r["n_chunks"] for r in got if r["n_chunks"])


def test_null_keys_stay(spark):
    docs = spark.createDataFrame([("en", 1, "a"), (None, 2, "b"), ("en", None, "c"), (None, None, "d")],
                                 "lang string, doc_id long, text string")
    assert sorted(r["text"] for r in load_pages(docs, "lang", "lang", "doc_id", "text").collect()) == list("abcd")
    r = spark.createDataFrame([(1, None, "s", "x"), (2, "2024-01-01", None, "x"), (3, "2024-01-02", "s", "y"), (4, None, None, "y")],
                              "event_id long, ts string, session_id string, domain string")
    r = r.withColumn("timestamp", F.col("ts").cast("timestamp"))
    assert sessions.conversation_segments(r).count() == 4
    assert sessions.history_positions(r, F.col("domain") == "z").count() == 4


@pytest.mark.parametrize("same", [True, False])
def test_hot_session_in_buckets(spark, same):
    """Sparse and identical timestamps: buckets stay even and results those of one window."""
    rng = np.random.default_rng(1)
    rows = [(i, 0 if same else int(rng.integers(0, 10**12)), "hot" if i % 3 else f"s{i % 40}", f"d{rng.integers(0, 3)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "event_id long, us long, session_id string, domain string")
    df = df.withColumn("timestamp", F.timestamp_micros("us"))
    got = {r["event_id"]: r["segment"] for r in sessions.conversation_segments(df, width=100).collect()}
    want, last = {}, {}
    for e, _, s, d in sorted(rows, key=lambda r: (r[1], r[0])):
        n, prev = last.get(s, (0, d))
        n += prev != d
        want[e], last[s] = n, (n, d)
    assert got == want
    from quarry.functions.ordinal import _bucketed
    sizes = [r["count"] for r in _bucketed(df, ["session_id"], ["timestamp", "event_id"], 100).groupBy("_b").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400


def test_scan_moves_the_rows_once(spark):
    p = sessions.conversation_segments(SourceTables(spark, SF_SMALL).turns())
    p.count()
    plan = p._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(_g") + plan.count("Exchange REPARTITION") <= 5


def test_fusion_beyond_rank_thousand(spark):
    keys = spark.createDataFrame([("d", 1, "k"), ("d", 2, "k")], "domain string, chunk_pos long, fkey string")
    v = spark.createDataFrame([(1, "d", 1, 1200, 0.5)], "question_id long, domain string, chunk_pos long, rank int, distance double")
    b = spark.createDataFrame([(1, "d", 2, 0)], "question_id long, domain string, chunk_pos long, rank int")
    r = fusion.rrf_fuse(fusion.rrf_contributions(v, b, keys)).first()
    assert r["chunk_pos"] == 1 and r["distance"] == 0.5


def test_cosine_of_zero_vectors_on_both_paths(spark):
    rows = [("d", 1, [0.0, 0.0]), ("d", 2, [1.0, 0.0]), ("d", 3, [1.0, 1.0])]
    c = spark.createDataFrame(rows, "domain string, chunk_pos long, vec array<double>")
    q = c.select(F.col("chunk_pos").alias("question_id"), "domain", F.col("vec").alias("qvec"))
    want = {(a[1], b[1]): r for a in rows for b in rows
            for r in [1.0 if not any(a[2]) or not any(b[2]) else round(1 - np.dot(a[2], b[2]) / np.linalg.norm(a[2]) / np.linalg.norm(b[2]), 6)]}
    got = {(r["question_id"], r["chunk_pos"]): r["distance"] for r in vector.vector_topk(q, c, metric="cosine").collect()}
    x = c.alias("a").join(c.alias("b"), "domain").select(F.col("a.chunk_pos").alias("i"), F.col("b.chunk_pos").alias("j"),
                                                         F.round(vector.cosine_distance("a.vec", "b.vec"), 6).alias("d"))
    assert got == pytest.approx(want) and {(r["i"], r["j"]): r["d"] for r in x.collect()} == pytest.approx(want)


def test_kernel_at_384_dims():
    rng = np.random.default_rng(0)
    q, c = rng.standard_normal((50, 384)), rng.standard_normal((700, 384))
    ids, pos, d = vector._local_topk(q, np.arange(50), None, c, np.arange(700), 5, 6, "l2")
    full = np.round(((q[:, None] - c[None]) ** 2).sum(axis=2), 6)
    for i in range(50):
        best = sorted(range(700), key=lambda j: (full[i, j], j))[:5]
        assert list(pos[ids == i]) == best and d[ids == i] == pytest.approx(full[i, best], abs=2e-6)


def test_stored_postings_are_read_by_term(spark):
    t = SourceTables(spark, SF_SMALL)
    root = shared_dir(spark, "by-term")
    ingest_plan.write_collection(search.build_collection(t.corpus()), root)
    coll = ingest_plan.read_collection(spark, root)
    q = t.questions()
    assert sorted(bm25.bm25_topk(q, coll.index).collect()) == sorted(bm25.bm25_topk(q, t.collection().index).collect())
    s = bm25.scores(q.limit(1), coll.index)
    s.count()
    plan = s._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "term_bucket" in plan and "PartitionFilters: [term_bucket" in plan.replace("isnotnull(term_bucket", "term_bucket").replace("isnotnull(domain", "term_bucket")


def _requests(spark):
    rows = [(1, 0, "s", "en", 0, False), (2, 1, "s", "en", 1, False), (3, 2, "s", "fr", 2, False), (4, 3, "s", "en", 3, True),
            (5, 4, "s", "en", 1, False), (6, 5, "s", "en", 0, False)]
    df = spark.createDataFrame(rows, "event_id long, s long, session_id string, domain string, question_id long, is_reset boolean")
    return df.select("*", F.timestamp_seconds("s").alias("timestamp"), F.concat(F.lit("q"), "event_id").alias("question"),
                     F.when(F.col("event_id") == 1, answers.REFUSAL).otherwise(F.concat(F.lit("a"), "event_id")).alias("answer"))


@pytest.mark.parametrize("last_n", [None, 2])
def test_history_of_requests(spark, last_n):
    got = {r["event_id"]: [(m["role"], m["content"]) for m in r["history"]]
           for r in sessions.request_history(_requests(spark), F.col("is_reset"), last_n, width=1).collect()}
    full = {1: [], 2: [("user", "q1"), ("assistant", answers.REFUSAL)], 3: [], 5: [], 6: [("user", "q5"), ("assistant", "a5")]}
    assert got == full


def test_prompts_and_log_of_conversations(spark):
    t = SourceTables(spark, SF_SMALL)
    r = t.chat_requests()
    p = session_prompts(r, F.col("is_reset"), t.collection(), t.catalog())
    sizes = [x["n"] for x in p.select(F.size("prompt").alias("n")).collect()]
    assert max(sizes) > 2 and all(n % 2 == 0 for n in sizes)
    roles = {x["r"] for x in p.select(F.explode(F.transform("prompt", lambda m: m["role"])).alias("r")).collect()}
    assert roles == {"system", "user", "assistant"}
    before = spark.sql("SELECT current_timestamp() AS t").first()["t"]
    from quarry.registry_conv import _test_answer_udf
    log = log_records(r, F.col("is_reset"), t.collection(), t.catalog(), _test_answer_udf()).collect()
    assert len(log) == r.where(~F.col("is_reset")).count()
    assert all(x["timestamp"] >= before for x in log) and len({x["timestamp"] for x in log}) == 1
    assert RESET_EVENT not in {x["domain"] for x in log}


def test_search_options(spark):
    """chunk_id keys keep chunks of one prefix apart; min_score drops the zero-score fill;
    rank_base shifts the reciprocal ranks; cosine distances are returned."""
    rows = [("d", i, i, 0, "x" * 100 + t) for i, t in enumerate([" alpha", " beta", " alpha beta"])]
    chunks = spark.createDataFrame(rows, "domain string, chunk_pos long, page long, chunk_no int, content string")
    coll = search.build_collection(chunks, persist=False)
    q = spark.createDataFrame([(1, "d", "alpha")], "question_id long, domain string, question string")
    assert search.hybrid_search(q, coll).count() == 1
    apart = search.hybrid_search(q, coll, key="chunk_id", min_score=0.0, rank_base=1).collect()
    assert len(apart) == 3 and max(r["score"] for r in apart) <= 2 / 61 + 1e-9
    cos = search.hybrid_search(q, coll, key="chunk_id", metric="cosine").collect()
    assert all(0 <= r["distance"] <= 2 for r in cos)
    assert bm25.bm25_topk(q, coll.index).count() == 3 and search.bm25_arm(q, coll, min_score=0.0).count() < 3
