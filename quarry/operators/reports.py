"""Log reports (A1-A3) and message counts.

The three report statements run as Spark SQL over a temp view of the log, the same
text a warehouse would run; ties get a deterministic tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def queries_per_domain(log: DataFrame) -> DataFrame:
    """A1: COUNT(*) per domain, most queried first (ties by domain)."""
    return (log.groupBy("domain").agg(F.count(F.lit(1)).alias("query_count"))
               .orderBy(F.col("query_count").desc(), F.col("domain").asc()))


def confidence_rate(log: DataFrame) -> DataFrame:
    """A2: confident count, total, percentage rounded to one decimal. A null flag
    counts in the total only."""
    return (log.groupBy("domain")
               .agg(F.count_if(F.col("confident") == F.lit(True)).alias("confident_count"),
                    F.count(F.lit(1)).alias("total"))
               .withColumn("confidence_rate_pct",
                           F.round(F.col("confident_count") / F.col("total") * F.lit(100.0), 1)))


def recent_questions(log: DataFrame, n: int = 5, tie_break: str | None = None) -> DataFrame:
    """A3: the ``n`` most recent questions (top-k, planned as TakeOrderedAndProject)."""
    order = [F.col("timestamp").desc()] + ([F.col(tie_break).desc()] if tie_break else [])
    cols = ["timestamp", "domain", "question"] + ([tie_break] if tie_break else [])
    return log.orderBy(*order).limit(n).select(*cols)


def message_counts(messages: DataFrame) -> DataFrame:
    """Messages per session."""
    return messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("message_count"))


REPORT_SQL = {
    "queries_per_domain": """
        SELECT domain, COUNT(*) AS query_count FROM {log}
        GROUP BY domain ORDER BY query_count DESC, domain""",
    "confidence_rate": """
        SELECT domain, COUNT_IF(confident = TRUE) AS confident_count, COUNT(*) AS total,
               ROUND(COUNT_IF(confident = TRUE) / COUNT(*) * 100, 1) AS confidence_rate_pct
        FROM {log} GROUP BY domain""",
    "recent_questions": """
        SELECT timestamp, domain, question FROM {log} ORDER BY timestamp DESC, session_id, domain, question LIMIT 5""",
}


def run_report_sql(log: DataFrame, name: str) -> DataFrame:
    """The report statements as SQL text over the log (no shared view name)."""
    return log.sparkSession.sql(REPORT_SQL[name], log=log)
