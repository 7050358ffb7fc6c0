"""Query log: one record per answered request, JSON lines partitioned by UTC day.

The original appends to one object per day with read-modify-write (concurrent writers
lose rows). Here the sink is append-only: every write adds files under
``log_date=YYYY-MM-DD/``; readers see the union. Records are read back with an
explicit schema (no inference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = ("timestamp timestamp, session_id string, domain string, question string, "
              "answer string, confident boolean, log_date string")
LOG_COLUMNS = ["timestamp", "session_id", "domain", "question", "answer", "confident"]


def log_day(ts) -> Column:
    """UTC calendar day of a timestamp as 'YYYY-MM-DD' (session time zone must be UTC)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.date_format(ts, "yyyy-MM-dd")


def iso_utc(ts) -> Column:
    """ISO-8601 text of a UTC instant as Python's ``datetime.isoformat()`` prints it:
    microseconds only when non-zero, offset ``+00:00``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.when(F.unix_micros(ts) % 1_000_000 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")) \
            .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))


def to_log_records(df: DataFrame) -> DataFrame:
    """Project answered requests onto the fixed log columns plus ``log_date``."""
    return df.select(*[F.col(c) for c in LOG_COLUMNS]).withColumn("log_date", log_day("timestamp"))


def to_json_line(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One JSON object per record (nulls kept), as appended to the day's object;
    ``keep`` columns are carried alongside."""
    rec = F.struct(iso_utc("timestamp").alias("timestamp"), "session_id", "domain", "question",
                   "answer", "confident")
    return df.select(*(keep or []), F.to_json(rec, {"ignoreNullFields": "false"}).alias("json"))


# Microsecond timestamps survive the JSON round trip (Spark's default keeps milliseconds).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


# Files per day and write: a day is split by session, small days make few files.
DAY_FILES = 4


def stamped(df: DataFrame) -> DataFrame:
    """Stamp answered requests with the current UTC time (one instant per batch)."""
    return df.withColumn("timestamp", F.current_timestamp())


def write_log(df: DataFrame, path: str) -> None:
    """Append records to the day partitions under ``path``, clustered by day. Retried tasks
    do not duplicate records; running the same batch twice does (append)."""
    (to_log_records(df).repartition("log_date", F.pmod(F.xxhash64("session_id"), F.lit(DAY_FILES))).write.mode("append").partitionBy("log_date")
        .option("timestampFormat", TS_FORMAT).json(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log table with its explicit schema."""
    return spark.read.schema(LOG_SCHEMA).option("timestampFormat", TS_FORMAT).json(path)
