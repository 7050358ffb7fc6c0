"""Domain catalog (S7): one small dimension table, the single copy of every per-domain
attribute (source file, description, prompt phrase, UI label, short description, tag)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CATALOG_SCHEMA = ("domain string, ord int, file string, description string, context string, "
                  "label string, short_desc string, tag string")


def _sql_str(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def catalog(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The catalog as a DataFrame; ``ord`` keeps the declaration order.

    Built as an inline VALUES table (a local relation compared by value), so every query
    that joins the catalog has an identical plan and reuses cached results built on it.
    """
    values = ", ".join("(" + ", ".join([_sql_str(r[0]), str(i)] + [_sql_str(x) for x in r[1:]]) + ")"
                       for i, r in enumerate(rows))
    cols = [c.split()[0] for c in CATALOG_SCHEMA.split(", ")]
    df = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(cols)})")
    return df.select(*[F.col(c).cast(t.split()[1]).alias(c) for c, t in zip(cols, CATALOG_SCHEMA.split(", "))])


def list_domains(cat: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Keys and descriptions, in catalog order (``ord``); with ``sources(domain, ...)`` also the number
    of its rows each domain has."""
    out = cat.select("ord", "domain", "description")
    if sources is None:
        return out
    n = sources.groupBy("domain").agg(F.count(F.lit(1)).alias("n_pages"))
    return out.join(n, "domain", "left").fillna(0, ["n_pages"])

