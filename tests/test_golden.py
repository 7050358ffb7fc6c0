"""Golden cases (FIXTURES.md section 3) on tiny hand-made corpora."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.operators import answers, bm25, chunking, fusion, reports
from quarry.plans import search

CORPUS = ["the data breach penalty is heavy", "the repo rate rises and the rate stays",
          "quick commerce grows", "data privacy law", "the law of the land"]


def _chunks(spark, texts, domain="d"):
    rows = [(domain, i, i, 0, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "domain string, chunk_pos long, page long, chunk_no int, content string")


def _questions(spark, qs, domain="d"):
    return spark.createDataFrame([(i, domain, q) for i, q in enumerate(qs)],
                                 "question_id long, domain string, question string")


def test_bm25_idf_and_eps(spark):
    idx = bm25.build_index(_chunks(spark, CORPUS))
    st = idx.stats.collect()[0]
    assert st["n_chunks"] == 5 and st["avgdl"] == pytest.approx(5.0)
    assert st["eps"] == pytest.approx(0.233551, abs=1e-6)
    idf = {r["term"]: r["idf"] for r in idx.idf.collect()}
    assert len(idf) == 18
    assert idf["the"] == pytest.approx(0.233551, abs=1e-6)
    assert idf["data"] == pytest.approx(0.336472, abs=1e-6)
    assert idf["rate"] == pytest.approx(1.098612, abs=1e-6)


@pytest.mark.parametrize("question,scores,order", [
    ("data breach penalty", [2.324492, 0, 0, 0.410332, 0], [0, 3, 1, 2, 4]),
    ("the rate", [0.214267, 1.595405, 0, 0, 0.333644], [1, 4, 0, 2, 3]),
    ("zzz", [0, 0, 0, 0, 0], [0, 1, 2, 3, 4]),
    ("law law", [0, 0, 0, 0.820664, 0.672944], [3, 4, 0, 1, 2]),
])
def test_bm25_scores_and_zero_fill(spark, question, scores, order):
    idx = bm25.build_index(_chunks(spark, CORPUS))
    top = bm25.bm25_topk(_questions(spark, [question]), idx, k=10).orderBy("rank").collect()
    assert [r["chunk_pos"] for r in top] == order
    got = {r["chunk_pos"]: r["score"] for r in top}
    for pos, s in enumerate(scores):
        assert got[pos] == pytest.approx(s, abs=1e-6)


def test_bm25_negative_eps_pad_rule(spark):
    # 'a' and 'b' are in most chunks, so eps < 0; more than 10 chunks, so matched chunks with
    # negative scores must rank below unmatched zero-score chunks.
    texts = ["a b"] * 9 + ["a"] * 3 + ["b"] * 3 + [""] * 2
    idx = bm25.build_index(_chunks(spark, texts))
    assert idx.stats.collect()[0]["eps"] < 0
    top = bm25.bm25_topk(_questions(spark, ["a"]), idx, k=10).orderBy("rank").collect()
    # brute force
    import math
    docs = [t.split() for t in texts]
    n = len(docs)
    avgdl = sum(map(len, docs)) / n
    dfs = {}
    for d in docs:
        for w in set(d):
            dfs[w] = dfs.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in dfs.items()}
    eps = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: (eps if v < 0 else v) for w, v in raw.items()}
    sc = [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avgdl))
              for q in ["a"]) for d in docs]
    want = sorted(range(n), key=lambda i: (-round(sc[i], 6), i))[:10]
    assert [r["chunk_pos"] for r in top] == want


def test_one_chunk_domain(spark):
    idx = bm25.build_index(_chunks(spark, ["only text here"]))
    top = bm25.bm25_topk(_questions(spark, ["text"]), idx).collect()
    assert len(top) == 1 and top[0]["chunk_pos"] == 0


def test_tokenize_unicode_whitespace(spark):
    s = " a b\x1cc\x85d 　E\x0bf"
    df = spark.createDataFrame([(s,)], "t string")
    assert df.select(tokenize("t").alias("x")).collect()[0]["x"] == ["a", "b", "c", "d", "e", "f"]


def test_fusion_golden(spark):
    cols = "question_id long, domain string, rank int, chunk_pos long, distance double"
    vec = spark.createDataFrame([(1, "d", 0, 0, 0.8), (1, "d", 1, 1, 0.9), (1, "d", 2, 2, 1.4)], cols)
    bm = spark.createDataFrame([(1, "d", 0, 2, 0.0), (1, "d", 1, 3, 0.0), (1, "d", 2, 0, 0.0), (1, "d", 3, 4, 0.0)],
                               "question_id long, domain string, rank int, chunk_pos long, score double")
    keys = spark.createDataFrame([("d", i, k) for i, k in enumerate("ABCDE")], "domain string, chunk_pos long, fkey string")
    out = fusion.rrf_fuse(fusion.rrf_contributions(vec, bm, keys)).orderBy("rank").collect()
    assert [("ABCDE"[r["chunk_pos"]], r["score"], r["distance"]) for r in out] == [
        ("A", pytest.approx(0.032795699, abs=1e-9), 0.8), ("C", pytest.approx(0.032795699, abs=1e-9), 1.4),
        ("B", pytest.approx(0.016393443, abs=1e-9), 0.9), ("D", pytest.approx(0.016393443, abs=1e-9), 1.0),
        ("E", pytest.approx(0.015873016, abs=1e-9), 1.0)]


def test_fusion_same_arm_collision(spark):
    cols = "question_id long, domain string, rank int, chunk_pos long, distance double"
    vec = spark.createDataFrame([(1, "d", 0, 0, 0.5), (1, "d", 1, 1, 0.7)], cols)
    bm = spark.createDataFrame([], "question_id long, domain string, rank int, chunk_pos long, score double")
    keys = spark.createDataFrame([("d", 0, "same"), ("d", 1, "same")], "domain string, chunk_pos long, fkey string")
    out = fusion.rrf_fuse(fusion.rrf_contributions(vec, bm, keys)).collect()
    assert len(out) == 1
    assert out[0]["score"] == pytest.approx(0.033060109, abs=1e-9)
    assert out[0]["chunk_pos"] == 0 and out[0]["distance"] == 0.5


@pytest.mark.parametrize("dist,confident,reason", [
    (1.3, True, None), (1.301, False, "Top result distance 1.301 exceeds threshold 1.3."),
    (1.0, True, None), (None, False, "No results found.")])
def test_gate(spark, dist, confident, reason):
    df = spark.createDataFrame([(dist,)], "d double")
    c, r = search.gate(F.col("d"))
    row = df.select(c.alias("c"), r.alias("r")).collect()[0]
    assert row["c"] == confident and row["r"] == reason


def test_unknown_domain_reason(spark):
    from quarry.sources.domains import catalog
    req = spark.createDataFrame([(1, "xyz", "q")], "question_id long, domain string, question string")
    row = search.validate(req, catalog(spark, [(d, d, "", "", "", "", "") for d in ("beta", "alpha", "o'neil")])).collect()[0]
    assert not row["valid"]
    assert row["reason"] == "Unknown domain 'xyz'. Available: ['beta', 'alpha', 'o'neil']"


@pytest.mark.parametrize("text,lengths", [
    ("x", [1]), ("x" * 999, [999]), ("x" * 1000, [1000]), ("x" * 1001, [1000, 201]),
    ("x" * 1800, [1000, 1000]), ("x" * 1801, [1000, 1000, 201]),
    (" ".join(["abcd"] * 500), [999, 999, 899]),
    ("A" * 600 + "\n\n" + "B" * 600 + "\n\n" + "C" * 100, [600, 702]),
    ("A" * 100 + "\n\n" + "B" * 1500, [100, 999, 701]), ("   ", [])])
def test_chunking_golden(spark, text, lengths):
    assert [len(c) for c in chunking.split_text(text)] == lengths
    pages = spark.createDataFrame([("d", "f", 0, text)], "domain string, file string, page long, text string")
    got = chunking.chunk_recursive(pages).orderBy("chunk_no").collect()
    assert [len(r["content"]) for r in got] == lengths


def test_windows_match_recursive_on_separator_free_text(spark):
    for n in [1, 999, 1000, 1001, 1800, 1801, 4321]:
        pages = spark.createDataFrame([("d", "f", 0, "y" * n)], "domain string, file string, page long, text string")
        w = [len(r["content"]) for r in chunking.chunk_windows(pages).orderBy("chunk_no").collect()]
        assert w == [len(c) for c in chunking.split_text("y" * n)]


def test_context_and_sources(spark):
    chunks = [(0, 0, 3, "c1", 0.1, 0.2), (1, 1, None, "c2", 0.1, 0.2)]
    df = spark.createDataFrame([(True, chunks)],
                               "confident boolean, chunks array<struct<rank:int,chunk_pos:bigint,page:int,"
                               "content:string,score:double,distance:double>>")
    row = df.select(answers.format_context("chunks").alias("ctx")).collect()[0]
    assert row["ctx"] == "[Source 1 | Page 3]\nc1\n\n[Source 2 | Page unknown]\nc2"
    three = [(0, 0, 7, "a", 0.0, 0.0), (1, 1, 2, "b", 0.0, 0.0), (2, 2, 7, "c", 0.0, 0.0)]
    df2 = spark.createDataFrame([(True, three), (False, three)], df.schema)
    got = [r["s"] for r in df2.select(answers.cited_sources("chunks", "confident").alias("s")).collect()]
    assert got == [[2, 7], []]


def test_history_with_reset(spark):
    from quarry.operators import sessions
    rows = [(1, "2024-01-01 00:00:00", "s", "d1", "q1"), (2, "2024-01-01 00:01:00", "s", "RESET", None),
            (3, "2024-01-01 00:02:00", "s", "d1", "q2"), (4, "2024-01-01 00:03:00", "s", "d1", "q3")]
    df = spark.createDataFrame(rows, "event_id long, ts string, session_id string, domain string, question string") \
              .withColumn("timestamp", F.to_timestamp("ts"))
    h = sessions.history_positions(df, F.col("domain") == "RESET").orderBy("event_id").collect()
    assert [(r["event_id"], r["epoch"], r["history_len"]) for r in h] == [(1, 0, 0), (3, 1, 0), (4, 1, 2)]
    turns = df.where("domain != 'RESET'").withColumn("answer", F.lit("a"))
    rep = sessions.reset_report(turns, df.where("domain = 'RESET'")).collect()
    assert rep[0]["cleared"] == ["d1"]


def test_confidence_rate_rounding(spark):
    rows = [("a", i < 9) for i in range(80)] + [("b", i < 1) for i in range(16)] + [("c", None), ("c", True)]
    df = spark.createDataFrame(rows, "domain string, confident boolean")
    got = {r["domain"]: (r["confident_count"], r["total"], r["confidence_rate_pct"])
           for r in reports.confidence_rate(df).collect()}
    assert got["a"] == (9, 80, 11.3) and got["b"] == (1, 16, 6.3) and got["c"] == (1, 2, 50.0)


def _toy_model():
    import numpy as np

    def f(texts):
        # deterministic stand-in encoder: letter histogram, L2-normalised
        out = np.zeros((len(texts), 26))
        for i, t in enumerate(texts):
            for ch in (t or "").lower():
                if "a" <= ch <= "z":
                    out[i, ord(ch) - 97] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)
    return f


def test_pluggable_encoder_in_hybrid_search(spark):
    from quarry.operators import vector
    enc = vector.encoder(_toy_model, 26)
    coll = search.build_collection(_chunks(spark, CORPUS), embed=enc)
    assert len(coll.vectors.first()["vec"]) == 26
    hits = search.hybrid_search(_questions(spark, ["data privacy law"]), coll, embed=enc).orderBy("rank").collect()
    assert len(hits) == 5 and hits[0]["chunk_pos"] == 3
