"""Repeatable log batches, open page metadata, single search of a batch, encoder checks."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import answers, vector
from quarry.plans import conversation, ingest, search
from quarry.session import shared_dir
from quarry.sources import log_batches
from quarry.sources.corpus import load_pages
from quarry.sources.testdata import SourceTables
from tests.conftest import SF_SMALL


def records(spark, rows):
    return spark.createDataFrame(rows, "session_id string, timestamp_text string").select(
        F.col("timestamp_text").cast("timestamp").alias("timestamp"), "session_id", F.lit("d").alias("domain"),
        F.lit("q").alias("question"), F.lit(None).cast("string").alias("answer"), F.lit(True).alias("confident"))


def seen(spark, root):
    return sorted((r.batch, r.session_id, r.log_date) for r in log_batches.read_batches(spark, root).collect())


def test_batches_once(spark):
    root = shared_dir(spark, "test-batches")
    assert seen(spark, root) == [] and log_batches.read_batches(spark, root).columns[-1] == "batch"
    one = records(spark, [("a", "2024-01-01 10:00:00"), ("a", "2024-01-01 10:00:00"), (None, "2024-01-02 10:00:00")])
    assert log_batches.append_batch(one, root, "007") and not log_batches.append_batch(one, root, "007")
    want = [("007", "a", "2024-01-01")] * 2
    got = log_batches.read_batches(spark, root)
    assert got.count() == 3 and got.where("session_id = 'a'").count() == 2 and got.where("batch = '007'").count() == 3
    # a run that died before its commit is not seen; the repeat replaces it, its other days included
    log_batches.write_records(records(spark, [("x", "2030-01-01 00:00:00"), ("y", "2024-01-01 00:00:00")]), root, "b")
    assert log_batches.read_batches(spark, root).count() == 3
    assert log_batches.append_batch(records(spark, [("y", "2024-01-01 00:00:00")]), root, "b")
    left = log_batches.read_batches(spark, root).where("session_id is not null")
    assert sorted((r.batch, r.session_id, r.log_date) for r in left.collect()) == want + [("b", "y", "2024-01-01")]
    # an empty batch is a batch
    assert log_batches.append_batch(one.limit(0), root, "empty") and not log_batches.append_batch(one, root, "empty")
    assert log_batches.read_batches(spark, root).count() == 4
    for bad in ("", "a/b", "_x", "a b"):
        with pytest.raises(ValueError):
            log_batches.append_batch(one, root, bad)


def test_stream_of_batches(spark):
    src, root = shared_dir(spark, "test-stream-in"), shared_dir(spark, "test-stream-out")
    records(spark, [("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 11:00:00")]).write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    log_batches.start_batched_stream(stream, root, shared_dir(spark, "test-stream-cp"), "s").awaitTermination()
    # the same micro-batch again, as after a lost checkpoint
    log_batches.start_batched_stream(stream, root, shared_dir(spark, "test-stream-cp"), "s").awaitTermination()
    assert seen(spark, root) == [("s-0", "a", "2024-01-01"), ("s-0", "b", "2024-01-01")]


def test_metadata_through_ingest_search_and_context(spark):
    docs = spark.createDataFrame([(i, f"word{i} common text number {i}", "en", {1: None}.get(i, f"site{i % 3}"), "x") for i in range(12)],
                                 "doc_id long, text string, lang string, source string, other string")
    cat = SourceTables(spark, SF_SMALL).catalog()
    pages = load_pages(docs, "lang", "lang", "doc_id", "text", ("source", "other"))
    root = shared_dir(spark, "test-meta")
    ingest.ingest(pages, cat, root, in_order=True, metadata=pages.where("page <> 2").select("domain", "page", "meta")).collect()
    coll = ingest.read_collection(spark, root)
    q = spark.createDataFrame([(1, "en", "word1 word2 word3")], "question_id long, domain string, question string")
    row = search.retrieve(q, coll, cat, threshold=9.0, n=12, k=12).first()
    assert row.confident and len(row.chunks) == 12 and [c.rank for c in row.chunks] == sorted(c.rank for c in row.chunks)
    for c in row.chunks:
        want = {} if c.page == 2 else {"source": None if c.page == 1 else f"site{c.page % 3}", "other": "x"}
        assert c.meta == want
    found = spark.createDataFrame([row], search.retrieve(q, coll, cat, threshold=9.0, n=12, k=12).schema)
    text = found.select(answers.format_context("chunks", ("source",))).first()[0]
    for c in row.chunks:
        source = "unknown" if c.page in (1, 2) else f"site{c.page % 3}"
        assert f"| Page {c.page} | source: {source}]\n{c.content}" in text
    assert "source" not in found.select(answers.format_context("chunks")).first()[0]
    plain = search.retrieve(q, replace(coll, metadata=None), cat).schema["chunks"].dataType.elementType
    assert "meta" not in plain.fieldNames()
    # an unknown domain has no chunks, of the same type
    none = search.retrieve(q.withColumn("domain", F.lit("xx")), coll, cat)
    assert none.first().chunks == [] and "meta" in none.schema["chunks"].dataType.elementType.fieldNames()


def test_collection_without_metadata(spark):
    docs = spark.createDataFrame([(1, "one text", "en")], "doc_id long, text string, lang string")
    root = shared_dir(spark, "test-nometa")
    ingest.ingest(load_pages(docs, "lang", "lang", "doc_id", "text"), SourceTables(spark, SF_SMALL).catalog(), root, in_order=True).collect()
    assert ingest.read_collection(spark, root).metadata is None


def test_a_batch_is_searched_once(spark):
    import quarry.registry  # noqa: F401 - the query groups import each other through it
    from quarry.registry_conv import _test_answer_udf
    t = SourceTables(spark, SF_SMALL)
    asked = t.questions().where("domain in ('en', 'fr') and question_id < 3").collect()
    requests = spark.createDataFrame([(i, "s", r.question_id, r.domain, r.question, "a", True) for i, r in enumerate(asked)],
                                     "event_id long, session_id string, question_id long, domain string, question string, "
                                     "answer string, confident boolean").withColumn("timestamp", F.timestamp_micros("event_id"))
    calls, real = [], search.hybrid_search
    try:
        search.hybrid_search = lambda *a, **k: calls.append(1) or real(*a, **k)
        log = conversation.log_records(requests, F.lit(False), t.collection(), t.catalog(), _test_answer_udf())
    finally:
        search.hybrid_search = real
    assert len(calls) == 1 and log.kept.is_cached and log.count() == len(asked) > 0
    log.kept.unpersist()


def test_encoder_shape_is_checked(spark):
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    good = vector.model_embed(df, "t", lambda: lambda x: np.array([[len(s), 1.0] for s in x]), 2).collect()
    assert sorted(r.embedding for r in good) == [[1.0, 1.0], [2.0, 1.0]]
    with pytest.raises(Exception, match="the encoder returned"):
        vector.model_embed(df, "t", lambda: lambda x: np.zeros((2 * len(x), 1)), 2).collect()
