"""Small helpers shared by the training-data operators: vectorised word hashes over the
UTF-8 buffer of an Arrow batch, byte-bounded batches, range parts and connected components.

Words here are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), as
written (no case folding). A shingle is five consecutive words; a text of one to four words
has one shingle of all its words; a text without words has none.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.session import shared_dir

SHINGLE = 5
#: Largest slice of text (bytes) that a helper below works on at once; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 (fixed public constants), vectorised."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _P) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its n+1 offsets, nulls as empty texts."""
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 16):
    """Cut a batch into runs of at most ``rows`` whole rows and ``limit`` text bytes (or one row)."""
    n = batch.num_rows
    if not n:
        return
    lens = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    at, total = 0, 0
    for i in range(n):
        if i > at and (total + lens[i] > limit or i - at >= rows):
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += lens[i]
    yield batch.slice(at, n - at)


def run_hashes(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of each run of bytes; run i begins at ``at[i]``, the last ends with ``body``. Eight bytes at a time
    go through :func:`mix64` with their place before they are summed, so that no pattern of bytes cancels out."""
    lens = np.diff(np.append(at, len(body)))
    place = np.arange(len(body)) - np.repeat(at, lens)
    lane = np.flatnonzero((place & 7) == 0)
    eight = np.add.reduceat(body.astype(np.uint64) << ((place & 7) << 3).astype(np.uint64), lane)
    mixed = mix64(mix64(eight + _P) + (place[lane] >> 3).astype(np.uint64) * _Q)
    n = (lens + 7) >> 3
    return mix64(np.add.reduceat(mixed, np.cumsum(n) - n) + lens.astype(np.uint64) * _P)


def words(raw: np.ndarray, off: np.ndarray, lower: bool = False):
    """(hash of each word, word count of each text) for texts laid end to end."""
    n = len(off) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
    first = solid & ~before
    body = raw[solid]
    if lower:
        body = body + ((body >= 65) & (body <= 90)).astype(np.uint8) * np.uint8(32)
    at = np.flatnonzero(first[solid])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    h = run_hashes(body, at)
    seen = np.concatenate(([0], np.cumsum(first)))
    return h, np.diff(seen[off])


def shingles(h: np.ndarray, counts: np.ndarray, size: int = SHINGLE):
    """(shingle hashes, shingle count of each text) from word hashes laid end to end."""
    n = np.where(counts == 0, 0, np.maximum(1, counts - (size - 1)))
    if not n.sum():
        return np.zeros(0, np.uint64), n
    start = np.cumsum(counts) - counts
    at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    end = np.repeat(start + counts, n)
    out = np.zeros(len(at), np.uint64)
    q = powers(size, _Q)
    padded = np.concatenate((h, np.zeros(size, np.uint64)))
    for k in range(size):
        out += np.where(at + k < end, padded[at + k] * q[k], np.uint64(0))
    return mix64(out), n


def text_shingles(col: pa.Array, size: int = SHINGLE):
    raw, off = text_buffer(col)
    return shingles(*words(raw, off), size)


def owners(counts: np.ndarray) -> np.ndarray:
    """Row index of each element when row i holds counts[i] of them."""
    return np.repeat(np.arange(len(counts)), counts)


def planes(a: np.ndarray) -> np.ndarray:
    """Bytes of an array, all first bytes before all second ones (compresses better)."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T)


def squeezed(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one compressed value, read again by :func:`unsqueezed`."""
    head = [(a.dtype.str, len(a)) for a in arrays]
    body = b"".join(planes(np.ascontiguousarray(a)).tobytes() for a in arrays)
    return pickle.dumps((head, len(body), pa.compress(body, codec="zstd", asbytes=True) if body else b""))


def unsqueezed(data: bytes) -> list[np.ndarray]:
    head, size, body = pickle.loads(data)
    body = pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for kind, n in head:
        kind = np.dtype(kind)
        raw = np.frombuffer(body, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(raw.T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives
    lost executors (never a machine-local folder)."""
    path = shared_dir(df.sparkSession, name) + "/t"
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`stored` of which everything that follows is stored itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: Column, parts: int) -> list[int]:
    """At most parts-1 ascending cut points of a long key, about equal counts between
    them (greenwald-khanna quantiles of the key column alone)."""
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(key, probs, max(10_000, 20 * parts)).alias("b")).first()
    return sorted({int(x) for x in (got["b"] or [])})


def part_of(key: Column, bounds: list[int]) -> Column:
    """Number of cut points at or below the key (JVM-side binary search by array filter)."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds])
    return F.aggregate(cuts, F.lit(0), lambda n, b: n + F.when(b <= key, 1).otherwise(0))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of the undirected long ``edges``; the component is its
    smallest id. Alternating large-star and small-star rounds (Kiveris et al., 2014): every
    round is a shuffle of the edges, each hub is aggregated by ``min`` before the shuffle and
    joined back by key, so that AQE can split a hub; nothing is collected. Each round is
    written to the shared folder. Empty edges give no rows.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = stored(e.where("u > v").distinct(), "links")
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                                             F.col("m").alias("v")).where("u > v").distinct())
        seen, was = Observation(), e
        seen_sum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        e = stored(small.observe(seen, F.count(F.lit(1)).alias("n"), seen_sum.alias("s")), "links")
        old = was.agg(F.count(F.lit(1)).alias("n"), seen_sum.alias("s")).first()
        now = seen.get
        discard(was)
        if old["n"] == now["n"] and old["s"] == now["s"]:
            break
    else:
        raise RuntimeError("components did not settle")
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until none is among ``taken`` (columns are equal in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out
