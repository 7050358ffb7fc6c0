"""Operator 5: temperature mixing of sources, in DataFrame functions only.

A source's share s of all tokens becomes the weight s^a / sum(s^a). The exponent a is found
by bisection: the largest one whose weights still reach a target entropy (nats), or the least
one that repeats no source more than ``max_repeat`` times. A source's quota is its weight of
the token budget; it is realised as blocks, each a permutation of all its rows by a hash of
id and block number: full blocks while the quota lasts, then the prefix of one more
permutation that fits in the rest. The key where that prefix ends is found by two rounds of
1,024 token sums per source and one ordered run over what falls between, so a source of any
size is never ordered in one task, and texts are never shuffled.

Tokens are words: maximal runs of characters other than ASCII white space.

Edge cases: a null text is empty; a null source is a source; rows of one id have the same place in
a permutation and are taken together or not at all; a source without tokens is kept once;
an empty table gives no rows; all columns of the input are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.broadcast import sized_broadcast
from quarry.llm import common

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 60
#: Token sums per source in each round of the search for a prefix; 15 hexadecimal digits of order.
FANOUT = 1024
ORDER_BITS = 60
#: Sources that are broadcast as one row each (more: an ordinary join).
MAX_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def place(doc_id: Column, block: Column, seed: int) -> Column:
    """60-bit place of an id in the permutation of a block."""
    text = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), block.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + f(y["s"]) * y["n"])


def exponent(shares: Column, entropy: float | None, max_repeat: float | None, cover: bool) -> Column:
    """Bisected exponent for an array of distinct positive shares ``s``, each held by ``n`` sources."""
    def reaches(a: Column) -> Column:  # the weights at a are flat enough
        z = _sum(shares, lambda s: F.pow(s, a))
        return -_sum(shares, lambda s: F.pow(s, a) / z * F.log(F.pow(s, a) / z)) >= F.lit(entropy)

    def within(a: Column) -> Column:  # no source repeats too often at a
        least, most = F.array_min(shares)["s"], F.array_max(shares)["s"]
        often = (F.pow(most / least, F.lit(1.0) - a) if cover
                 else F.pow(least, a - 1.0) / _sum(shares, lambda s: F.pow(s, a)))
        return often <= F.lit(max_repeat)

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        up = reaches(mid) if entropy is not None else ~within(mid)
        return F.struct(F.when(up, mid).otherwise(acc["lo"]).alias("lo"), F.when(up, acc["hi"]).otherwise(mid).alias("hi"))

    top = 16.0 if entropy is not None else 1.0
    ends = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(0.0).alias("lo"), F.lit(top).alias("hi")), step)
    return ends["lo"] if entropy is not None else ends["hi"]


def weights(totals: DataFrame, entropy: float | None = None, max_repeat: float | None = None,
            budget_tokens: int | None = None, cover: bool = False) -> DataFrame:
    """source, tokens, weight, quota of ``totals(source, tokens)``. The budget is
    ``budget_tokens``, or all tokens; with ``cover`` the least one that takes every row of every
    source at least once."""
    if (entropy is None) == (max_repeat is None):
        raise ValueError("give a target entropy or a repetition limit")
    if max_repeat is not None and max_repeat < 1:
        raise ValueError("a repetition limit is at least 1")
    # one pair a distinct total, in one row
    row = totals.where("tokens > 0").groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    row = row.agg(F.array_sort(F.collect_list(F.struct("tokens", "n"))).alias("t"))
    row = row.withColumn("all", F.aggregate("t", F.lit(0).cast("long"), lambda x, y: x + y["tokens"] * y["n"]))
    row = row.withColumn("s", F.transform("t", lambda x: F.struct((x["tokens"] / F.col("all")).alias("s"), x["n"].alias("n"))))
    row = row.withColumn("a", exponent(F.col("s"), entropy, max_repeat, cover))
    row = row.withColumn("z", _sum(F.col("s"), lambda s: F.pow(s, F.col("a"))))
    budget = F.col("all") if budget_tokens is None else F.lit(budget_tokens)
    if cover:
        budget = F.aggregate("t", F.lit(0.0), lambda x, y: F.greatest(
            x, y["tokens"] / (F.pow(y["tokens"] / F.col("all"), F.col("a")) / F.col("z"))))
    # one value, evaluated once
    mixed = row.select(F.struct("all", "a", "z", budget.cast("double").alias("budget"))).scalar()
    got = totals.withColumn("_m", mixed).select("source", "tokens", "_m.all", "_m.a", "_m.z", "_m.budget")
    w = F.pow(F.col("tokens") / F.col("all"), F.col("a")) / F.col("z")
    got = got.withColumn("weight", F.when(F.col("tokens") > 0, w).otherwise(F.lit(0.0)))
    quota = F.floor(F.col("weight") * F.col("budget") + F.lit(1e-6)).cast("long")
    # with cover each source has one full block at least, whatever the rounding
    return got.select("source", "tokens", "weight", "a", (F.greatest(quota, F.col("tokens")) if cover else quota).alias("quota"))


def _crossing(sums: DataFrame, rest: str) -> DataFrame:
    """Per source the first cell whose running sum exceeds ``rest``, and the sum before it."""
    from pyspark.sql import Window
    w = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("_run", F.sum("n").over(w)).where(F.col("_run") > F.col(rest))
    return run.groupBy("source").agg(F.min(F.struct("cell", (F.col("_run") - F.col("n")).alias("before"))).alias("c"))


def plan(rows: DataFrame, seed: int, **target) -> DataFrame:
    """source, blocks (full ones), cut (places below it are in the partial block) for
    ``rows(source, doc_id, tokens)``; all of a source's places are below 2^60."""
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    w = common.stored(weights(totals, **target), "mix-weights")
    blocks = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(F.lit(1)).cast("int")
    w = w.withColumn("blocks", blocks).withColumn("rest", F.when(F.col("tokens") > 0, F.col("quota") - F.col("tokens") * F.col("blocks")).otherwise(F.lit(0)))
    small = sized_broadcast(w.select(F.col("source").alias("_s"), "blocks", "rest", F.col("tokens").alias("_all")), MAX_SOURCES)
    at = (rows.join(small, F.col("source").eqNullSafe(F.col("_s"))).where("_all > 0")
          .select("source", "rest", "tokens", place(F.col("doc_id"), F.col("blocks"), seed).alias("place")))
    at = common.stored(at, "mix-places")
    width = 1 << (ORDER_BITS - 10)
    first = _crossing(at.groupBy("source", "rest", F.floor(F.col("place") / width).alias("cell")).agg(F.sum("tokens").alias("n")), "rest")
    first = first.select(F.col("source").alias("_s"), F.col("c.cell").alias("_cell"), F.col("c.before").alias("_before"))
    near = at.join(sized_broadcast(first, MAX_SOURCES), F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("place") / width) == F.col("_cell")))
    near = near.select("source", "place", "tokens", (F.col("rest") - F.col("_before")).alias("rest"))
    second = _crossing(near.groupBy("source", "rest", F.floor(F.col("place") / (width >> 10)).alias("cell")).agg(F.sum("tokens").alias("n")), "rest")
    second = second.select(F.col("source").alias("_s"), F.col("c.cell").alias("_cell"), F.col("c.before").alias("_before"))
    last = near.join(sized_broadcast(second, MAX_SOURCES), F.col("source").eqNullSafe(F.col("_s")) & (F.floor(F.col("place") / (width >> 10)) == F.col("_cell")))
    last = last.groupBy("source", (F.col("rest") - F.col("_before")).alias("rest"), F.col("place").alias("cell")).agg(F.sum("tokens").alias("n"))
    cut = _crossing(last, "rest").select(F.col("source").alias("_s"), F.col("c.cell").alias("cut"))
    got = w.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "tokens", "weight", "a", "quota", "blocks", "cut")
    return common.stored(got, "mix-plan")


def mix(docs: DataFrame, seed: int = 0, block: str = "_block", at: str = "_place", **target) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` as often as their sources' weights ask, with the
    columns ``block`` (number of the permutation) and ``at`` (order in it), which replace equally named ones."""
    rows = docs.select("source", "doc_id", n_words(F.col("text")).alias("tokens"))
    p = plan(rows, seed, **target)
    own, blocks, cut = common.fresh([*docs.columns, block, at], "_s", "_blocks", "_cut")
    p = sized_broadcast(p.select(F.col("source").alias(own), F.col("blocks").alias(blocks), F.col("cut").alias(cut)), MAX_SOURCES)
    got = docs.join(p, docs["source"].eqNullSafe(F.col(own)))
    # rows at or beyond the cut do not fit; no cut: all of them fit, which only a rest of zero-token rows can do
    partial = F.coalesce(place(F.col("doc_id"), F.col(blocks), seed) < F.col(cut), F.lit(False))
    copies = F.col(blocks) + F.when(partial, 1).otherwise(0)
    got = got.where(copies > 0).withColumn(block, F.explode(F.sequence(F.lit(0), copies - 1)))
    return got.withColumn(at, place(F.col("doc_id"), F.col(block), seed)).drop(own, blocks, cut)


#: Production target of the query: no source repeats more than this, over a budget of all tokens.
MAX_REPEAT = 1.25


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, max_repeat=MAX_REPEAT).select(
        "doc_id", "source", F.col("_block").alias("block"), F.col("_place").alias("place"), n_words(F.col("text")).alias("n_tokens"))


OP5_SQL = f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
totals AS MATERIALIZED (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY source),
shares AS MATERIALIZED (
  SELECT source, tokens, tokens / (SELECT sum(tokens) FROM totals)::DOUBLE AS s FROM totals WHERE tokens > 0),
bisect(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT i, lo, hi, (SELECT min(s) ** ((b.lo + b.hi) / 2 - 1) / sum(s ** ((b.lo + b.hi) / 2)) FROM shares) <= {MAX_REPEAT} AS ok
        FROM bisect b WHERE i < {ROUNDS})),
a AS (SELECT hi AS a FROM bisect WHERE i = {ROUNDS}),
quotas AS MATERIALIZED (
  SELECT source, tokens, floor(s ** (SELECT a FROM a) / (SELECT sum(s ** (SELECT a FROM a)) FROM shares)
                               * (SELECT sum(tokens) FROM totals) + 1e-6)::BIGINT AS quota FROM shares),
plan AS MATERIALIZED (SELECT source, quota // tokens AS blocks, quota % tokens AS rest FROM quotas
  UNION ALL SELECT source, 1, 0 FROM totals WHERE tokens = 0),
placed AS MATERIALIZED (
  SELECT d.*, p.blocks, p.rest, ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), p.blocks::VARCHAR, '0')), 1, 15))::BIGINT AS spot
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY spot RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM placed),
copies AS (
  SELECT *, CASE WHEN spot < (SELECT min(spot) FROM run r WHERE r.total > r.rest AND r.source IS NOT DISTINCT FROM x.source)
             AND (SELECT sum(tokens) FROM totals t WHERE t.source IS NOT DISTINCT FROM x.source) > 0 THEN 1 ELSE 0 END AS extra FROM run x)
SELECT doc_id, source, block::INTEGER AS block,
       ('0x' || substr(md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), block::VARCHAR, '0')), 1, 15))::BIGINT AS place,
       n_tokens::BIGINT AS n_tokens
FROM (SELECT doc_id, source, n_tokens, unnest(range(blocks + extra)) AS block FROM copies)
"""


def entropy_of(shares: list[float], a: float) -> float:
    """Entropy of the weights at exponent ``a`` (for checks)."""
    z = sum(s ** a for s in shares)
    return -sum(s ** a / z * math.log(s ** a / z) for s in shares)
