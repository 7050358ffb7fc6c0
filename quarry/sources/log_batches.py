"""Query-log batches that can be repeated (S5): each batch gives its records once however often it runs.

Layout under ``root``:
  records/batch=<id>/log_date=YYYY-MM-DD/   JSON lines of the batch
  commits/batch=<id>/                       one row (records), written last

A batch writes its own folder as a whole, then its commit. Readers take the records of committed
batches only, so a run that died between the two is unseen until it is repeated, which replaces
what it left. Running a committed batch again does nothing. A batch id has one writer at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from quarry.functions.broadcast import sized_broadcast
from quarry.sources.querylog import DAY_FILES, LOG_SCHEMA, TS_FORMAT, to_log_records

_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _commits(spark: SparkSession, path: str) -> DataFrame | None:
    """Commit rows under ``path``; None where nothing was ever committed."""
    try:
        return spark.read.schema("records long").json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def is_committed(spark: SparkSession, root: str, batch: str) -> bool:
    done = _commits(spark, f"{root}/commits/batch={batch}")
    return done is not None and not done.isEmpty()


def write_records(df: DataFrame, root: str, batch: str) -> None:
    """Replace the batch's records; unseen until :func:`commit`."""
    records = to_log_records(df).repartition("log_date", F.pmod(F.xxhash64("session_id"), F.lit(DAY_FILES)))
    (records.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("log_date")
        .option("timestampFormat", TS_FORMAT).json(f"{root}/records/batch={batch}"))


def commit(spark: SparkSession, root: str, batch: str) -> int:
    """Count the written records, and make them visible. A batch without records is committed too."""
    try:
        n = spark.read.schema(LOG_SCHEMA).json(f"{root}/records/batch={batch}").count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        n = 0
    spark.range(1, numPartitions=1).select(F.lit(n).cast("long").alias("records")).write.mode("overwrite") \
        .json(f"{root}/commits/batch={batch}")
    return n


def append_batch(df: DataFrame, root: str, batch: str) -> bool:
    """Append answered requests as the batch ``batch`` (letters, digits, '.', '_', '-'). False, and
    nothing is written, if it is committed already."""
    if not _ID.fullmatch(batch):
        raise ValueError(f"not a batch id: {batch!r}")
    spark = df.sparkSession
    if is_committed(spark, root, batch):
        return False
    write_records(df, root, batch)
    commit(spark, root, batch)
    return True


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """The log table of all committed batches, with their ids (``batch``)."""
    done = _commits(spark, f"{root}/commits")
    if done is None or "batch" not in done.columns:
        return spark.createDataFrame([], f"{LOG_SCHEMA}, batch string")
    # ids stay text whatever they look like
    done = done.select(F.regexp_extract(F.input_file_name(), r"batch=([^/]+)/", 1).alias("batch")).distinct()
    log = (spark.read.schema(f"{LOG_SCHEMA}, batch string").option("timestampFormat", TS_FORMAT).json(f"{root}/records"))
    return log.join(sized_broadcast(done), "batch", "left_semi").select(*[c for c in log.columns if c != "batch"], "batch")


def start_batched_stream(records: DataFrame, root: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """A stream of answered requests, each micro-batch as the batch ``<name>-<number>``: a
    micro-batch that is run again after a failure is not appended twice."""
    return (records.writeStream.foreachBatch(lambda df, i: append_batch(df, root, f"{name}-{i}") and None)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
