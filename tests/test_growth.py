"""Steps whose cost grew faster than the tables: look-up of cuts, probes as rows, vectors held by a worker, postings as rows."""

import tracemalloc
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.functions import ordinal
from quarry.operators import ivf, vector
from quarry.plans import search


def test_bucket_of_a_row_does_not_look_at_every_cut(spark):
    """512 cuts were compared with each row."""
    rows = [(i % 7, None if i % 50 == 0 else i // 3, i) for i in range(600)]
    df = spark.createDataFrame(rows, "g long, t long, e long")
    cuts = sorted({(None if t is None else t, e) for _, t, e in rows[::11]}, key=lambda c: (c[0] is not None, c[0] or 0, c[1]))
    made = ordinal._bucketed(df, ["g"], ["t", "e"], 1, cuts)
    assert "filter(" not in made._jdf.queryExecution().optimizedPlan().toString()
    key = lambda t, e: (t is not None, t or 0, e)
    want = {e: bisect_right([key(*c) for c in cuts], key(t, e)) for _, t, e in rows}
    assert {r["e"]: r["_b"] for r in made.collect()} == want
    text = df.select("g", F.format_string("%05d", "e").alias("s"))
    of_text = ordinal._bucketed(text, ["g"], ["s"], 1, [("00100",), ("00200",), ("00300",)])
    assert {(int(r["s"]) // 100, r["_b"]) for r in of_text.where("s < '00400'").collect()} == {(0, 0), (1, 1), (2, 2), (3, 3)}


def test_terms_are_counted_where_the_chunk_lies(spark):
    """A chunk's postings were rows before they were counted, embedded and kept."""
    texts = [("a", 0, "To be or not to be"), ("a", 1, None), ("a", 2, "   "), ("b", 0, "x x Y")]
    df = spark.createDataFrame(texts, "domain string, chunk_pos long, content string")
    got = {(r["domain"], r["chunk_pos"]): r for r in vector.with_terms(df, "content").collect()}
    want = {(r["domain"], r["chunk_pos"]): r["embedding"] for r in vector.hash_embed(df, ["domain", "chunk_pos"], "content").collect()}
    for d, p, t in texts:
        r = got[(d, p)]
        assert r["dl"] == (None if t is None else len(t.lower().split())) and r["vec"] == want[(d, p)]
        assert {x["term"]: x["f"] for x in r["terms"]} == Counter((t or "").lower().split())
    coll = search.build_collection(df)
    kept = coll.cached[0]
    assert kept.count() == len(texts) and set(kept.columns) == {"domain", "chunk_pos", "dl", "terms", "vec"}
    coll.release()


def test_a_question_goes_once_to_a_group_of_cells(spark, tmp_path):
    """A question's vector went to every cell that it probes."""
    rng = np.random.default_rng(2)
    rows = [("a", i, rng.normal(size=4).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "domain string, chunk_pos long, vec array<double>")
    root = f"{tmp_path}/i"
    ivf.build(v, root, cells=12)
    q = v.select(F.col("chunk_pos").alias("question_id"), "domain", F.col("vec").alias("qvec"))
    probing, stored = ivf._probing(q, root, 12, False)
    sent = ivf._grouped_candidates(probing, stored, 5, 6, "l2", False, 1000)
    assert sent.count() == 300 * 5  # a top k of each question, not of each cell
    got = sorted((r["question_id"], r["rank"], r["chunk_pos"]) for r in ivf.search(q, root, 5, probes=12, block_rows=50).collect())
    want = sorted((r["question_id"], r["rank"], r["chunk_pos"]) for r in vector.vector_topk(q, v, 5).collect())
    assert got == want


def test_a_worker_holds_few_distances():
    rng = np.random.default_rng(1)
    c, q = rng.normal(size=(20_000, 8)), rng.normal(size=(1_000, 8))
    tracemalloc.start()
    vector._local_topk(q, np.arange(1_000), np.arange(1_000), c, np.arange(20_000), 10, 6, "l2")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20, peak


def test_slices_of_tokens_give_the_same_terms(monkeypatch):
    tokens = pa.array([["a", "b", "a"], None, [], ["b"] * 5, ["c"]])
    whole = vector._terms_of(tokens, 8)
    parts = pa.concat_arrays([vector._terms_of(tokens.slice(i, 1), 8) for i in range(5)])
    assert [sorted((t["term"], t["f"]) for t in r["terms"]) for r in whole.to_pylist()] == \
        [sorted((t["term"], t["f"]) for t in r["terms"]) for r in parts.to_pylist()]
    assert whole.field("vec").to_pylist() == parts.field("vec").to_pylist()
