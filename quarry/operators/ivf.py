"""Stored inverted-file vector index (E4): vectors by (domain, cell), searched in the nearest cells.

Layout under a folder: ``centers`` (cell, center), ``vectors/domain=<d>/cell=<c>/`` (chunk_pos, vec), ``settings`` (one row:
probes, target and measured recall).

* About sqrt(n) cells (n: all vectors), k-means centres of a bounded sample (:data:`SAMPLE` rows a cell). A cell's rows are
  dealt to as many tasks as its size asks for, so a cell that holds a third of all vectors is no single task and no single file.
* ``probes`` is calibrated: the exact neighbours of sampled vectors are looked up among the cells nearest to each, and the
  least number of cells that reaches the target recall is stored. Calibration reads all vectors once.
* ``add`` assigns new vectors to the stored cells and appends; ``recalibrate`` measures the probes anew.
* A batch reads the directories of its questions' cells only (their numbers, at most domains x cells, are the one thing that
  reaches the driver) and compares exactly inside them; a large cell is cut into blocks like a large domain.

Edge cases: null domains are kept and found; an empty table stores no cell and answers nothing; fewer vectors than cells
leave one cell each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.broadcast import dim_broadcast
from quarry.operators import vector

MAX_CELLS = 4096
#: Sampled rows a cell for the centres, sampled questions for the calibration.
SAMPLE, QUESTIONS = 64, 256
#: Rows of a cell that one task writes.
CELL_ROWS = 200_000


def _assigned(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    v = vector.nearest_cells(vectors.select("domain", "chunk_pos", "vec"), "vec", centers, 1, "_near")
    return v.withColumn("cell", F.col("_near")[0]).drop("_near")


def _write(vectors: DataFrame, centers: np.ndarray, root: str, mode: str, cell_rows: int) -> None:
    v = _assigned(vectors, centers)
    # one row per (domain, cell)
    size = v.groupBy("domain", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int").alias("_parts"))
    size = size.select(F.struct("domain", "cell").alias("_c"), "_parts")
    dealt = v.withColumn("_c", F.struct("domain", "cell")).join(dim_broadcast(size), "_c").withColumn(
        "_part", F.pmod(F.xxhash64("chunk_pos"), F.col("_parts")))
    (dealt.repartition("domain", "cell", "_part").select("domain", "cell", "chunk_pos", "vec").sortWithinPartitions("domain", "cell", "chunk_pos")
          .write.mode(mode).partitionBy("domain", "cell").parquet(f"{root}/vectors"))


def build(vectors: DataFrame, root: str, k: int = 10, recall: float = 0.95, cells: int | None = None, metric: str = "l2",
          cell_rows: int = CELL_ROWS) -> None:
    """Write the index of ``vectors(domain, chunk_pos, vec)`` to ``root``."""
    spark = vectors.sparkSession
    n = vectors.count()
    cells = cells or max(1, min(MAX_CELLS, round(math.sqrt(n))))
    centers = vector.cell_centers(vectors, cells, SAMPLE * cells) if n > 1 else np.array([r["vec"] for r in vectors.select("vec").collect()])
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cell int, center array<double>").coalesce(1).write.parquet(f"{root}/centers")
    if n:
        _write(vectors, centers, root, "overwrite", cell_rows)
    recalibrate(spark, root, k, recall, metric)


def add(vectors: DataFrame, root: str, cell_rows: int = CELL_ROWS) -> None:
    """Append vectors to their cells (a position that is already stored would be stored twice)."""
    _write(vectors, _centers(vectors.sparkSession, root), root, "append", cell_rows)


def _centers(spark: SparkSession, root: str) -> np.ndarray:
    return np.array([r["center"] for r in spark.read.parquet(f"{root}/centers").orderBy("cell").collect()])


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    kinds = "chunk_pos long, vec array<double>, domain string, cell int"
    return spark.read.schema(kinds).parquet(f"{root}/vectors")


def recalibrate(spark: SparkSession, root: str, k: int = 10, recall: float = 0.95, metric: str = "l2") -> tuple[int, float]:
    """Least probes whose cells hold ``recall`` of the exact neighbours of sampled vectors; stored with the recall measured."""
    centers = _centers(spark, root)
    probes, got = 1, 1.0
    if len(centers) > 1:
        stored = _vectors(spark, root)
        asked = stored.orderBy(F.xxhash64("chunk_pos", F.lit(11))).limit(QUESTIONS).select(
            F.col("chunk_pos").alias("question_id"), "domain", F.col("vec").alias("qvec"), F.col("chunk_pos").alias("self_pos"))
        asked = vector.nearest_cells(asked, "qvec", centers, len(centers), "_order").persist()
        true = vector.vector_topk(asked.drop("_order"), stored, k, metric=metric, exclude_self=True)
        # at most QUESTIONS x k rows
        hits = true.join(F.broadcast(asked.select("question_id", "_order")), "question_id")
        cell = stored.select(F.col("domain").alias("_d"), "chunk_pos", "cell").join(
            F.broadcast(hits.select("question_id", F.col("domain").alias("_e"), "chunk_pos", "_order")), "chunk_pos").where(F.col("_d").eqNullSafe(F.col("_e")))
        at = [r["at"] for r in cell.select(F.array_position("_order", F.col("cell")).alias("at")).collect()]
        asked.unpersist()
        if at:
            rank = np.sort(np.array(at, np.int64))
            probes = int(rank[math.ceil(recall * len(rank)) - 1])
            got = float((rank <= probes).mean())
    spark.createDataFrame([(probes, recall, got)], "probes int, target double, recall double").coalesce(1).write.mode("overwrite").parquet(f"{root}/settings")
    return probes, got


def candidates(queries: DataFrame, root: str, probes: int | None = None, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(questions, stored vectors) with ``domain`` replaced by the (domain, cell) to be compared inside."""
    q, v = _probing(queries, root, probes, exclude_self)
    key = F.concat_ws("\u0001", "domain", F.col("cell").cast("string"))
    own = ["self_pos"] if exclude_self else []
    return (q.withColumn("cell", F.explode("near")).select("question_id", key.alias("domain"), "qvec", *own),
            v.select(key.alias("domain"), "chunk_pos", "vec"))


def _probing(queries: DataFrame, root: str, probes: int | None, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """(questions with ``near``, the cells they probe; stored vectors with their ``cell``), ``domain`` made a text without nulls."""
    spark = queries.sparkSession
    centers = _centers(spark, root)
    probes = probes or spark.read.parquet(f"{root}/settings").first()["probes"]
    own = ["self_pos"] if exclude_self else []
    q = vector.nearest_cells(queries, "qvec", centers, min(probes, len(centers)), "near")
    where = q.select("domain", F.explode("near").alias("cell")).distinct().collect()
    v = _vectors(spark, root)
    names = {r["domain"] for r in where}
    inside = F.col("domain").isin([d for d in names if d is not None])
    if None in names:
        inside |= F.col("domain").isNull()
    v = v.where(inside & F.col("cell").isin(sorted({r["cell"] for r in where})))
    key = F.concat_ws("\u0001", F.coalesce("domain", F.lit("")), F.isnull("domain").cast("string"))
    return (q.select("question_id", key.alias("domain"), "near", "qvec", *own), v.select(key.alias("domain"), "cell", "chunk_pos", "vec"))


def _grouped_candidates(q: DataFrame, v: DataFrame, k: int, digits: int | None, metric: str, exclude_self: bool, block_rows: int) -> DataFrame:
    """Local top k of every (block of questions, group of cells). Cells of a domain are grouped to about ``block_rows`` vectors
    (a larger cell is cut by the hash of its positions), so a question goes once to a group, with the group's cells that it
    probes, and not once to each cell."""
    size = v.groupBy("domain", "cell").agg(F.count(F.lit(1)).alias("_n"))
    # one row per (domain, cell), windows inside a domain: bounded by the cells
    before = Window.partitionBy("domain").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select("domain", "cell", F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_subs"),
                       F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / F.lit(block_rows)).cast("int").alias("_grp"))
    asked = q.groupBy("domain").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_nq"))
    groups = (size.withColumn("_sub", F.explode(F.sequence(F.lit(0), F.col("_subs") - 1))).groupBy("domain", "_grp", "_sub")
              .agg(F.collect_list("cell").alias("_cells")).groupBy("domain").agg(F.collect_list(F.struct("_grp", "_sub", "_cells")).alias("_groups")))
    own = ["self_pos"] if exclude_self else []
    qs = q.join(dim_broadcast(groups), "domain").join(dim_broadcast(asked), "domain")
    qs = qs.select("question_id", "domain", "near", "qvec", *own, F.pmod(F.xxhash64("question_id"), F.col("_nq")).cast("int").alias("_qb"), F.explode("_groups").alias("_g"))
    qs = qs.select("question_id", "domain", "qvec", *own, "_qb", F.col("_g._grp").alias("_grp"), F.col("_g._sub").alias("_sub"),
                   F.array_intersect("near", "_g._cells").alias("near")).where(F.size("near") > 0)
    vs = v.join(dim_broadcast(size), ["domain", "cell"]).join(dim_broadcast(asked), "domain")
    vs = vs.select("domain", "cell", "chunk_pos", "vec", "_grp", F.pmod(F.xxhash64("chunk_pos"), F.col("_subs")).cast("int").alias("_sub"),
                   F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)).alias("_qb"))

    def fn(key, corpus: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if corpus.empty or qs.empty:
            return pd.DataFrame({"question_id": pd.Series([], dtype="int64"), "domain": pd.Series([], dtype="object"),
                                 "chunk_pos": pd.Series([], dtype="int64"), "distance": pd.Series([], dtype="float64")})
        corpus = corpus.sort_values("cell", kind="stable")
        C, pos = np.stack(corpus["vec"].to_numpy()).astype(np.float64), corpus["chunk_pos"].to_numpy(np.int64)
        Q, qid, near = np.stack(qs["qvec"].to_numpy()).astype(np.float64), qs["question_id"].to_numpy(np.int64), qs["near"].to_numpy()
        self_pos = qs["self_pos"].to_numpy(np.int64) if exclude_self else None
        cells, first = np.unique(corpus["cell"].to_numpy(np.int64), return_index=True)
        # who probes each cell; only those are compared with its vectors
        who, number = np.repeat(np.arange(len(qs)), [len(x) for x in near]), np.concatenate(near)
        order = np.argsort(number, kind="stable")
        who, number = who[order], number[order]
        from_, to_ = np.searchsorted(number, cells), np.searchsorted(number, cells, "right")
        parts = [(qid[:0], pos[:0], np.zeros(0))]
        for x, y, lo, hi in zip(from_, to_, first, np.append(first[1:], len(corpus)), strict=True):
            if y > x:
                own = who[x:y]
                parts.append(vector._local_topk(Q[own], qid[own], None if self_pos is None else self_pos[own], C[lo:hi], pos[lo:hi], k, digits, metric))
        q_, p, d = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((p, d, q_))
        q_, p, d = q_[order], p[order], d[order]
        best = np.arange(len(q_)) - np.searchsorted(q_, q_) < k
        return pd.DataFrame({"question_id": q_[best], "domain": key[0], "chunk_pos": p[best], "distance": d[best]})

    by = ["domain", "_grp", "_sub", "_qb"]
    return vs.groupBy(*by).cogroup(qs.groupBy(*by)).applyInPandas(fn, vector._TOPK_SCHEMA)


def search(queries: DataFrame, root: str, k: int = 10, digits: int | None = 6, probes: int | None = None, metric: str = "l2",
           exclude_self: bool = False, block_rows: int = 20_000) -> DataFrame:
    """Approximate top k of ``queries(question_id, domain, qvec[, self_pos])``: (question_id, domain, rank, chunk_pos,
    distance) with exact distances; ``probes``: cells a question (default: as calibrated)."""
    if not len(_centers(queries.sparkSession, root)):
        return vector.final_topk(queries.sparkSession.createDataFrame([], "question_id long, domain string, chunk_pos long, distance double"), k)
    q, v = _probing(queries, root, probes, exclude_self)
    got = _grouped_candidates(q, v, k, digits, metric, exclude_self, block_rows)
    parts = F.split("domain", "\u0001")
    return vector.final_topk(got.withColumn("domain", F.when(parts[1] == "false", parts[0])), k)
