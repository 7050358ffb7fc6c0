"""Registered queries: Structured Streaming forms of the log append and conversation state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators.answers import REFUSAL
from quarry.registry_conv import EVENTS_CTE, TS_SQL, TS_TEXT
from quarry.registry import register
from quarry.session import shared_dir
from quarry.sources.testdata import (RESET_EVENT, TEST_ANSWER_PREFIX, requests_from_events,
                                     turns_from_requests)
from quarry.streaming import history_stream, log_stream


def _events_stream(spark, sf_dir):
    return log_stream.stream_file_source(spark, sf_dir.rstrip("/"), glob="events.parquet")


@register("stream_log", f"""WITH {EVENTS_CTE}
SELECT {TS_SQL.format(c='ts')} AS timestamp, session_id, domain, question, answer, confident,
       strftime(ts, '%Y-%m-%d') AS log_date
FROM turns""")
def q_stream_log(spark, sf_dir):
    """ST1: the events file as a stream of answered requests -> day-partitioned JSON log
    (checkpointed file sink, availableNow), read back as the log table."""
    src = _events_stream(spark, sf_dir)
    to_records = lambda s: turns_from_requests(requests_from_events(s))
    log = log_stream.run_log_stream(spark, src, to_records, shared_dir(spark, "stream-log"),
                                    shared_dir(spark, "stream-log-ckpt"))
    return log.select(F.date_format("timestamp", TS_TEXT).alias("timestamp"), "session_id", "domain",
                      "question", "answer", "confident", "log_date")


@register("stream_history", f"""WITH {EVENTS_CTE},
ep AS (
  SELECT *, CAST(sum(CASE WHEN domain = 'signup' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch
  FROM ev)
SELECT event_id, session_id, domain, epoch,
       CAST(row_number() OVER (PARTITION BY session_id, domain, epoch ORDER BY ts, event_id) - 1 AS BIGINT) AS turn_no,
       CAST(2 * (row_number() OVER (PARTITION BY session_id, domain, epoch ORDER BY ts, event_id) - 1) AS BIGINT) AS history_len
FROM ep WHERE domain <> 'signup'""")
def q_stream_history(spark, sf_dir):
    """ST2: keyed conversation state (applyInPandasWithState); equals history_with_reset."""
    req = requests_from_events(_events_stream(spark, sf_dir))
    req = req.withColumn("answer", F.when(F.col("confident"), F.concat(F.lit(TEST_ANSWER_PREFIX), F.col("question")))
                                    .otherwise(F.lit(REFUSAL)))
    return history_stream.run_history_stream(req, RESET_EVENT, shared_dir(spark, "stream-history"),
                                              shared_dir(spark, "stream-history-ckpt"))
