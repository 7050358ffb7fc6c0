"""Operator 2: vector best-fit packing of tokenised documents into bounded sequences.

A sequence has three capacities: tokens, pieces (documents) and attention cost (sum of the
squared piece lengths). Pieces are taken longest first; among the open sequences that hold a
piece under every capacity, the one with the least weighted residual norm (or the greatest
weighted dot product of piece and residual) gets it; where none does, a sequence is opened.
Packing needs lengths only: texts are tokenised where they are read and are never shuffled.

Pieces are dealt to shards by a hash of their identity and their place in the task that read them, so a shard is an even
sample whatever one key holds and however many rows are equal, and each shard is packed by one task. A shard leaves about one sequence partly
filled, under 0.1 % at the default of 50,000 documents a shard.

Edge cases: a null text is empty, an empty document is its end id alone; repeated rows are
packed as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common
from quarry.llm.tokens import encoder, tokenizer_path

PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, n_pieces int")


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole sequences, a shorter first piece."""
    if n <= limit:
        return [(0, n)]
    head = n % limit
    out = [(0, head)] if head else []
    return out + [(s, limit) for s in range(head, n, limit)]


def tokenized_pieces(docs: DataFrame, path: str, end_id: int, limit: int, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document; ``with_ids`` adds the ids (array<int>)."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tail = np.array([end_id], "<u4")
        for big in batches:
            for b in common.slices(big, limit=2 << 20):
                rows: list[list] = [[] for _ in names]
                flat, off = enc.ids(b.column("text"))
                for doc, lo, hi in zip(b.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                    ids = np.concatenate((flat[lo:hi], tail))
                    parts = cut(len(ids), limit)
                    for k, (s, n) in enumerate(parts):
                        own = ids[s:s + n]
                        one = [doc, k, s, n, zlib.crc32(own.tobytes()), len(parts)]
                        if with_ids:
                            one.append(own.astype(np.int32))
                        for c, v in zip(rows, one, strict=True):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: int,
             weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset, sequences used) of each piece, for one shard."""
    cap = np.array([max_tokens, max_docs, max_cost], dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64)
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.empty((1024, 3))
    number = np.empty(1024, np.int64)  # of the sequence behind each open row
    n_open, used, at = 0, 0, np.argsort(-lengths, kind="stable")
    smallest = int(lengths.min()) if len(lengths) else 0
    for i in at:
        n = float(lengths[i])
        item = np.array([n, 1.0, n * n])
        if (item > cap).any():
            raise ValueError(f"a piece of {int(n)} tokens fits no sequence")
        room = left[:n_open]
        fits = np.flatnonzero((room[:, 0] >= n) & (room[:, 1] >= 1) & (room[:, 2] >= n * n))
        if len(fits):
            rest = (room[fits] - item) / cap
            score = (rest * rest) @ w if rule == "norm" else -((room[fits] / cap) @ (w * item / cap))
            k = int(fits[np.argmin(score)])
        else:
            if n_open == len(left):
                left = np.concatenate((left, np.empty_like(left)))
                number = np.concatenate((number, np.empty_like(number)))
            k, left[n_open], number[n_open] = n_open, cap, used
            n_open, used = n_open + 1, used + 1
        place[i], offset[i] = number[k], max_tokens - int(left[k, 0])
        left[k] -= item
        if left[k, 0] < smallest or left[k, 1] < 1 or left[k, 2] < smallest * smallest:  # full
            n_open -= 1
            left[k], number[k] = left[n_open], number[n_open]
    return place, offset, used


def pack(pieces: DataFrame, max_tokens: int = 1024, max_docs: int | None = None, max_cost: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", shards: int = 1) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``length``; other columns are kept.
    Capacities left None do not bind beyond the token capacity."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is 'norm' or 'dot'")
    max_docs = max_docs or max_tokens
    max_cost = max_cost or max_tokens * max_tokens
    keys = [c for c, kind in pieces.dtypes if not kind.startswith(("array", "map", "struct"))]
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    out = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        place, offset, _ = best_fit(frame["length"].to_numpy(np.int64), max_tokens, max_docs, max_cost, weights, rule)
        return frame.assign(sequence_id=(frame["_shard"].to_numpy(np.int64) << 32) + place, offset=offset)

    return dealt.groupBy("_shard").applyInPandas(run, out).drop("_shard")


def shards_for(docs: DataFrame, docs_per_shard: int) -> int:
    return max(1, -(-docs.count() // docs_per_shard))


def pack_documents(docs: DataFrame, path: str, max_tokens: int = 1024, end_id: int = 2,
                   docs_per_shard: int = 50_000, with_ids: bool = False, **capacities) -> DataFrame:
    """Tokenise, cut and pack ``docs(doc_id, text)``: one row per piece."""
    p = tokenized_pieces(docs, path, end_id, max_tokens, with_ids)
    return pack(p, max_tokens, shards=shards_for(docs, docs_per_shard), **capacities)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 1024, end_id=2).drop("n_pieces")
