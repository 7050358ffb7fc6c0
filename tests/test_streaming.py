"""Stateful stream across many micro-batches equals the batch computation."""

from pyspark.sql import functions as F

from quarry.operators import sessions
from quarry.operators.answers import REFUSAL
from quarry.session import shared_dir
from quarry.sources.testdata import (RESET_EVENT, TEST_ANSWER_PREFIX, SourceTables,
                                     requests_from_events)
from quarry.streaming import history_stream, log_stream
from tests.conftest import SF_SMALL


def test_history_state_across_micro_batches(spark):
    ev = SourceTables(spark, SF_SMALL).table("events")
    # one file per day, streamed one file per trigger: arrival order follows time
    src = shared_dir(spark, "events-by-day")
    (ev.withColumn("day", F.to_date("ts")).repartition("day").sortWithinPartitions("ts", "event_id")
       .write.mode("overwrite").partitionBy("day").parquet(src))
    days = ev.select(F.to_date("ts")).distinct().count()
    assert days > 5
    stream = (spark.readStream.schema(spark.read.parquet(src).schema)
              .option("maxFilesPerTrigger", 1).parquet(src))
    req = requests_from_events(stream)
    req = req.withColumn("answer", F.when(F.col("confident"), F.concat(F.lit(TEST_ANSWER_PREFIX), F.col("question")))
                                    .otherwise(F.lit(REFUSAL)))
    out = history_stream.run_history_stream(req, RESET_EVENT, shared_dir(spark, "hist-out"),
                                            shared_dir(spark, "hist-ckpt"))
    batch = sessions.history_positions(requests_from_events(ev), F.col("domain") == RESET_EVENT)
    cols = ["event_id", "session_id", "domain", "epoch", "turn_no", "history_len"]
    assert sorted(out.select(*cols).collect()) == sorted(batch.select(*cols).collect())


def test_log_stream_appends_day_partitions(spark):
    t = SourceTables(spark, SF_SMALL)
    path = shared_dir(spark, "log")
    src = log_stream.stream_file_source(spark, SF_SMALL, glob="events.parquet")
    log = log_stream.run_log_stream(spark, src, lambda s: requests_from_events(s).where(F.col("domain") != RESET_EVENT)
                                    .withColumn("answer", F.lit("a")), path, shared_dir(spark, "log-ckpt"))
    n = t.requests().where(F.col("domain") != RESET_EVENT).count()
    assert log.count() == n
    assert log.select("log_date").distinct().count() == \
        t.requests().select(F.date_format("timestamp", "yyyy-MM-dd")).distinct().count()
