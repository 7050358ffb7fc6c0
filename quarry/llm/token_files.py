"""Operator 8: flat token-id files with 64-bit document offsets, memory-mapped for reading.

A data set is a folder of shards in ascending order of their documents' ids. Shard k has

* ``k.bin``  the ids of its documents end to end, little-endian unsigned 16- or 32-bit;
* ``k.idx``  little-endian signed 64-bit: one offset per document (in ids, from the shard's
  begin) and the end, then the documents' ids (a null id as the least 64-bit integer).

Documents are dealt into ranges of (id, first 256 characters, text hash, place read), so that one id or one text of any
number of rows is cut like any other, and a range is one shard. No list of cut points is looked up, and a task streams its
range: it holds one slice of text and 16 bytes a document.

A shard's base, its first document's place in the whole, is the prefix sum of the token counts of the shards
before it; only one (shard, documents, tokens) row a shard passes through the driver.
A shard is written under a name of its own attempt and renamed, so that a repeated or
speculative task leaves the same file. The folder is in the shared folder of the cluster, reached as a file
system path; only token ids are read through memory maps, one shard a task.

Edge cases: a null text is empty and has the end id alone; a null id sorts first; repeated
rows and ids are all written, ordered by the text's first 256 characters, then its hash; an empty table makes no shard and no rows; other
columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.tokens import encoder, tokenizer_path
from quarry.session import shared_dir

#: Text bytes of one shard, on average; larger if there would be more than ``MOST_SHARDS``.
SHARD_BYTES = 16 << 20
MOST_SHARDS = 50_000
_NO_ID = -(1 << 63)
MANIFEST = "shard int, n_docs long, n_tokens long"


def local_path(path: str) -> str:
    """File system path of a shared folder (``file:`` or plain)."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"token files are memory-mapped and need a mounted folder, not {path}")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def shard_files(folder: str, shard: int) -> tuple[str, str]:
    return f"{folder}/{shard:06d}.bin", f"{folder}/{shard:06d}.idx"


def write_shard(folder: str, shard: int, parts: Iterator[tuple[list[int | None], np.ndarray, np.ndarray]],
                width: int) -> tuple[int, int]:
    """Write one shard from parts (documents' ids, token ids end to end, token ids of each document) as they come;
    returns its numbers of documents and of token ids."""
    os.makedirs(folder, exist_ok=True)
    flat, index = shard_files(folder, shard)
    own, docs, counts = uuid.uuid4().hex, [np.zeros(0, "<i8")], [np.zeros(0, np.int64)]
    with open(f"{flat}.{own}", "wb") as f:
        for doc, ids, n in parts:
            f.write(ids.astype(f"<u{width}").tobytes())
            docs.append(np.array([_NO_ID if d is None else d for d in doc], "<i8"))
            counts.append(n)
    ends = np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype("<i8")
    with open(f"{index}.{own}", "wb") as f:
        f.write(ends.tobytes())
        f.write(np.concatenate(docs).tobytes())
    for path in (flat, index):
        os.replace(f"{path}.{own}", path)
    return len(ends) - 1, int(ends[-1])


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, width: int = 2,
                 shard_bytes: int = SHARD_BYTES) -> list[tuple[int, int, int, int]]:
    """Encode and write ``docs(doc_id, text)``; returns the manifest (shard, documents,
    tokens, base), a row a shard."""
    folder = local_path(folder)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = min(MOST_SHARDS, max(1, -(-total // shard_bytes)))
    order = ["doc_id", "head", "digest", "place"]
    dealt = (docs.withColumns({"head": F.substring("text", 1, 256), "digest": F.xxhash64("text"),
                               "place": F.monotonically_increasing_id()})
             .repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text"))
    kinds = pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)

        def encoded(first: pa.RecordBatch) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
            for big in itertools.chain([first], batches):
                for b in common.slices(big, limit=2 << 20):
                    flat, off = enc.ids(b.column("text"))
                    yield b.column("doc_id").to_pylist(), np.insert(flat, off[1:], end_id), np.diff(off) + 1

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            shard = TaskContext.get().partitionId()
            n_docs, n_tokens = write_shard(folder, shard, encoded(first), width)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(
                ([shard], [n_docs], [n_tokens]), kinds.types, strict=True)], schema=kinds)

    out, base = [], 0
    for r in sorted(dealt.mapInArrow(run, MANIFEST).collect()):
        out.append((r["shard"], r["n_docs"], r["n_tokens"], base))
        base += r["n_tokens"]
    return out


def read_tokens(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int, int]], width: int = 2,
                with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start (over all shards), n_tokens,
    ids_crc32 of the ids as unsigned 32-bit, and the ids themselves if ``with_ids``."""
    folder = local_path(folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
             *([("ids", pa.list_(pa.int64()))] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, n, _, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                flat, index = shard_files(folder, shard)
                index = np.fromfile(index, "<i8")
                off, doc = index[:n + 1], index[n + 1:]
                ids = np.memmap(flat, f"<u{width}", "r")
                for a in range(0, n, 4096):
                    z = min(n, a + 4096)
                    own = [ids[off[i]:off[i + 1]].astype("<u4") for i in range(a, z)]
                    cols = [pa.array(doc[a:z], mask=doc[a:z] == _NO_ID), pa.array(off[a:z] + base),
                            pa.array(np.diff(off[a:z + 1])), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, schema=pa.schema(kinds))

    rows = spark.createDataFrame(manifest, MANIFEST + ", base long")
    return rows.repartition(max(1, min(len(manifest), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    manifest = write_tokens(common.table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, folder, manifest)
