"""Operator 11: sharding by longest-processing-time scheduling.

Rows of one group (equal texts) stay together. Groups, largest first, go each to the shard
with the least load so far, kept in a heap (ties: the lowest shard number). Groups of one size are
interchangeable, so the schedule runs over (size, number of groups): the groups of a size go
to all shards up to a common water level at once, and through the heap from there, which gives exactly
the loads of one heap step per group. Distinct sizes are few by proof: d of them hold d*d/2
bytes at least, so a table of B bytes has at most sqrt(2B) (245 thousand at 30 GB, 14 million at
100 TB), and one task schedules them; no group or row passes through a single task.

Steps: (1) one scan gives id, size, checksum and text digest of each row, written once; (2) rows
are summed by digest (partial aggregation takes a hot group), groups numbered inside their size
by range positions; (3) the schedule gives each size its shards' shares, a group finds its shard by its
number; (4) rows join their group's shard by digest (a sort-merge join, whose hot side AQE splits);
(5) slots are range positions in the order (shard, id, digest). Only keys move, texts never.

A shard can be larger than the others only as far as one group makes it so: no load exceeds the
mean by more than the group placed last on it.

Edge cases: a null text is empty (one group with empty texts); null ids come first in a shard;
repeated rows have a slot each; an empty table gives no rows; other columns are ignored, so names cannot
clash; fewer groups than shards leave shards empty.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ranges import positions, ranged
from quarry.llm import common

SHARDS = 24
#: Bytes that a row counts beyond its text.
ROW_BYTES = 8
#: Groups of one size up to which the heap places them one by one.
ONE_BY_ONE = 64


def place(loads: list[int], size: int, n: int) -> list[int]:
    """Groups of ``size`` bytes that each shard gets when ``n`` go one after another to the least
    loaded shard; ``loads`` grow by them."""
    got = [0] * len(loads)
    if n > ONE_BY_ONE and size > 0:
        # Real water level of n*size bytes; every step that begins a whole size below it is taken.
        ordered, filled, level = sorted(loads), 0, 0.0
        for k, x in enumerate(ordered):
            filled += x
            level = (n * size + filled) // (k + 1)
            if k + 1 == len(ordered) or level <= ordered[k + 1]:
                break
        for k, x in enumerate(loads):
            got[k] = max(0, -(-(level - size - x) // size))
    heap = [(x + g * size, k) for k, (x, g) in enumerate(zip(loads, got, strict=True))]
    heapq.heapify(heap)
    for _ in range(n - sum(got)):
        x, k = heap[0]
        got[k] += 1
        heapq.heapreplace(heap, (x + size, k))
    for k, g in enumerate(got):
        loads[k] += g * size
    return got


def schedule(sizes: DataFrame, shards: int) -> DataFrame:
    """(bytes, upto): of a size's groups, numbered from 0, shard k takes those from upto[k-1] below upto[k].
    ``sizes`` is (bytes, n), one row per distinct size."""
    kinds = pa.schema([("bytes", pa.int64()), ("upto", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads = [0] * shards
        for b in batches:
            upto = [np.cumsum(place(loads, s, n)) for s, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(upto, kinds.field(1).type)], schema=kinds)

    ordered = sizes.select("bytes", "n").repartition(1).sortWithinPartitions(F.desc("bytes"))
    return ordered.mapInArrow(run, "bytes long, upto array<long>")


def shard_groups(rows: DataFrame, shards: int = SHARDS, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, shard) of every distinct ``key`` of ``rows(key, size)``, by longest processing time."""
    keep = keep or (lambda df: common.stored(df, "lpt"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    numbered = positions(ranged(groups, ["bytes", "key"], keep), ["bytes"], "number").select("key", "bytes", "number")
    shares = keep(schedule(groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")), shards))
    shard = F.size(F.filter("upto", lambda u: u <= F.col("number")))
    return numbered.join(shares, "bytes").select("key", shard.cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: Column | None = None, size: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with ``shard`` and ``slot`` (its place there, by doc_id); columns of these names
    are replaced. ``key``: rows that must stay together (default: equal texts); ``size``: bytes of a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.sha2(text, 256) if key is None else key
    size = (F.octet_length(text) + ROW_BYTES) if size is None else size
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    packed = docs.select(key.alias("key"), size.cast("long").alias("size"), F.col("doc_id").alias("id"),
                         F.monotonically_increasing_id().alias("tie"), F.struct(*own).alias("row"))
    kept = common.stored(packed, "lpt")
    return slots(kept, shard_groups(kept.select("key", "size"), shards)).select("row.*", "shard", "slot")


def slots(rows: DataFrame, shard_of: DataFrame) -> DataFrame:
    """``rows(key, id, tie, ...)`` with their group's ``shard`` and a gapless ``slot`` in it."""
    placed = ranged(rows.join(shard_of, "key"), ["shard", "id", "key", "tie"], lambda df: common.stored(df, "lpt"))
    # shards and ranges are few: one base per (range, shard) at most
    return positions(placed, ["shard"], "slot", small=True)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in slot order over as many files as its bytes ask for."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
            .write.mode("overwrite").partitionBy("shard").parquet(path))


def op11_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = common.table(spark, sf_dir, "documents")
    rows = common.stored(docs.select(
        F.col("doc_id").alias("id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("key"), F.monotonically_increasing_id().alias("tie")), "lpt")
    return slots(rows, shard_groups(rows.select("key", "size"))).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


# The heap as a recursive query, a group a step; then the groups of one size in digest order take that size's shards in order.
# crc32 by its polynomial, a table of 256 entries made from it.
OP11_SQL = """
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS k,
         octet_length(encode(coalesce(text, ''))) + 8 AS size FROM documents),
tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) s(i))),
crcs AS MATERIALIZED (
  SELECT k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda x: ('0x' || h[x:x + 1])::BIGINT)),
                lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM (SELECT k, hex(encode(any_value(t))) AS h FROM docs GROUP BY k), tab),
grp AS MATERIALIZED (
  SELECT k, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, k) AS i FROM docs GROUP BY k),
heap(i, bytes, loads, shard) AS (
  SELECT 0::BIGINT, 0::BIGINT, list_transform(range(24), lambda x: 0::BIGINT), 0::BIGINT
  UNION ALL
  SELECT g.i, g.bytes, list_transform(h.loads, lambda x, j: x + CASE WHEN j = list_position(h.loads, list_min(h.loads)) THEN g.bytes ELSE 0 END),
         list_position(h.loads, list_min(h.loads))::BIGINT - 1
  FROM heap h JOIN grp g ON g.i = h.i + 1),
picks AS (SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard, i) AS n FROM heap WHERE i > 0),
home AS (SELECT g.k, p.shard FROM (SELECT *, row_number() OVER (PARTITION BY bytes ORDER BY k) AS n FROM grp) g JOIN picks p USING (bytes, n))
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, d.k, r) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM docs d JOIN home USING (k) JOIN crcs USING (k)
"""
