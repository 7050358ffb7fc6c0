"""What a task or an executor holds does not grow with the corpus or the log (round 4, F1-F16)."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quarry.functions import ranges
from quarry.operators import blocks, bm25, chunking, vector
from quarry.plans import ingest, search
from quarry.plans.conversation import session_prompts
from quarry.session import shared_dir
from quarry.sources.corpus import load_pages
from quarry.sources.domains import catalog

CAT = [("en", "en", "d", "the documents", "l", "s", "t")]
CHUNKS = [("en", 0, 0, 0, "To be or not to be"), ("en", 1, 1, 0, None), ("en", 2, 2, 0, "   "), ("en", 3, 3, 0, "x x Y be")]


def _chunks(spark):
    return spark.createDataFrame(CHUNKS, "domain string, chunk_pos long, page long, chunk_no int, content string")


def _in_memory(spark):
    """Rows that are kept in memory: RDD ids."""
    return {i for i, r in dict(spark.sparkContext._jsc.getPersistentRDDs()).items() if r.getStorageLevel().useMemory()}


def test_tables_of_the_corpus_are_kept_on_disk(spark):
    """Blocks in memory filled the heap: 1,800 MB of it were gone when 0.5 GB of documents were kept."""
    before = _in_memory(spark)
    docs = spark.createDataFrame([(1, "one text", "en"), (2, "two texts", "en")], "doc_id long, text string, lang string")
    pages = load_pages(docs, "lang", "lang", "doc_id", "text")
    assert pages.count() == 2
    coll = search.build_collection(_chunks(spark)).persist()
    for df in (coll.chunks, coll.vectors, coll.index.postings, coll.index.idf):
        df.count()
    level = coll.cached[0].storageLevel
    assert level.useDisk and not level.useMemory
    for df in (coll.chunks, coll.index.idf, ranges.kept(docs)):
        assert df.storageLevel.useDisk and not df.storageLevel.useMemory
    assert _in_memory(spark) == before
    coll.release()
    got = ingest.ingest(pages, catalog(spark, CAT), shared_dir(spark, "memory"), chunking.chunk_windows, in_order=True).collect()
    assert [(r.n_pages, r.n_chunks, r.n_stored) for r in got] == [(2, 2, 2)] and _in_memory(spark) == before


def test_counted_terms_are_kept_packed(spark):
    """A kept row had an array of structs: some 50 bytes a term besides its letters."""
    counted = search.build_collection(_chunks(spark)).cached[0]
    assert counted.schema["terms"].dataType.simpleString() == "struct<words:string,f:array<int>>"
    key = lambda r: (r.domain, r.chunk_pos, r.dl, r.term or "", r.f)
    got = sorted(map(key, bm25.postings(bm25.postings_in_place(counted)).collect()))
    assert got == sorted(map(key, bm25.postings(_chunks(spark)).collect())) and len(got) == 7
    rows = bm25.postings_in_place(counted)
    assert rows.where("term is null").count() == 2 and rows.schema["f"].dataType.simpleString() == "bigint"
    counted.unpersist()


def test_packed_terms_are_those_of_the_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "", None, "c " * 5])], "i long, t string")
    plain = {r.i: ([(x.term, x.f) for x in r.terms], r.vec, r.dl) for r in vector.with_terms(df, "t").collect()}
    packed = {r.i: (list(zip(r.terms.words.split(), r.terms.f, strict=True)), r.vec, r.dl) for r in vector.with_terms(df, "t", packed=True).collect()}
    assert packed == plain


def test_many_keys_go_to_parquet_in_short_lists(spark, tmp_path):
    """A list of 1,500 keys was one chain of comparisons, which overran the stack of a task."""
    spark.range(20_000).select(F.lit("en").alias("domain"), F.col("id").alias("hash")).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    keys = np.arange(blocks.KEYS) * 7
    got = blocks.Blocks(table, table).within(table, pd.DataFrame({"domain": "en", "hash": keys}), "hash")
    twice = blocks.Blocks(table, table).within(table, pd.DataFrame({"domain": "en", "hash": [7, 7, 14]}), "hash")
    assert twice.count() == 2  # terms of several questions come several times
    assert sorted(r.hash for r in got.collect()) == keys.tolist()
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == blocks.KEYS // blocks.IN_KEYS


def test_chunks_do_not_go_with_the_requests(spark):
    """All chunks of a request went through the exchange by event id that gives it its history. Requests of one id have each
    other's histories, those without an id none."""
    cat = catalog(spark, CAT)
    coll = search.build_collection(_chunks(spark).where("content is not null"))
    rows = [(1, 1, False), (2, 2, False), (2, 3, False), (None, 4, False), (3, 5, True), (4, 6, False)]
    requests = spark.createDataFrame(rows, "event_id long, s long, is_reset boolean").select(
        "event_id", F.timestamp_seconds("s").alias("timestamp"), F.lit("s").alias("session_id"), F.lit("en").alias("domain"),
        F.lit(7).cast("long").alias("question_id"), F.lit("to be").alias("question"), F.concat(F.lit("a"), "s").alias("answer"), "is_reset")
    found = ranges.kept(search.retrieve(requests.limit(1).select("question_id", "domain", "question"), coll, cat, threshold=99.0))
    p = session_prompts(requests, F.col("is_reset"), coll, cat, found=found)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter, (event_id" not in plan and "Window [collect_list" in plan
    got = sorted((r.event_id or 0, r.answer, [m.content for m in r.prompt[1:-1]][1::2]) for r in p.collect())
    assert got == [(0, "a4", []), (1, "a1", []), (2, "a2", ["a1"]), (2, "a2", ["a1", "a2"]), (2, "a3", ["a1"]), (2, "a3", ["a1", "a2"]),
                   (4, "a6", [])]
    assert all(r.prompt[0].role == "system" and "To be or not" in r.prompt[0].content and r.prompt[-1].content == "to be" for r in p.collect())
    found.unpersist()
