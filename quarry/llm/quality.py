"""Operator 9: byte-level convolutional network, in numpy, scoring whole texts for quality.

Filters of ``WIDTH`` bytes run over every byte of the text. Chunks of two adjacent blocks of
``BLOCK`` bytes overlap by half and cover the whole text; each filter is max-pooled within a
chunk, the chunk vectors of a text are combined by mean, maximum and minimum, and a small
hidden layer gives one probability. A filter is a table with a weight for each of its byte
places and each byte value, so that a convolution is ``WIDTH`` table look-ups and sums.

Training takes a bounded sample of labelled texts (``max_rows`` of label 0 and of label 1, texts up to
``max_bytes``; both parameters), whole, in one Spark task with a fixed seed; scoring takes
all bytes of all texts. Only text bytes enter a score.

Edge cases: a null text is empty and is scored like any other; a null id is neither held out
nor a training row; null labels are not used, repeated label rows count once (the least label);
no labels of both classes give an untrained score of 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

WIDTH, FILTERS, BLOCK, HIDDEN = 6, 32, 256, 16
THRESHOLD = 0.3
PAD = 256
#: Byte places convolved at once.
TILE = 1 << 15


def blocks(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(padded byte values of all texts in whole blocks, blocks of each text)."""
    size = np.diff(off)
    n = -(-(size + WIDTH - 1) // BLOCK)
    out = np.full(int(n.sum()) * BLOCK + WIDTH, PAD, np.int16)
    start = (np.cumsum(n) - n) * BLOCK
    out[np.repeat(start - off[:-1], size) + np.arange(len(raw))] = raw
    return out, n


def convolve(table: np.ndarray, values: np.ndarray, arg: bool = False):
    """Largest response of each filter in each block, and its place when ``arg``."""
    n = (len(values) - WIDTH) // BLOCK
    top = np.empty((n, FILTERS), np.float32)
    where = np.empty((n, FILTERS), np.int64) if arg else None
    step = TILE // BLOCK
    for a in range(0, n, step):
        b = min(n, a + step)
        lo, hi = a * BLOCK, b * BLOCK
        r = table[0].take(values[lo:hi], axis=0)
        for k in range(1, WIDTH):
            r += table[k].take(values[lo + k:hi + k], axis=0)
        r[values[lo:hi] == PAD] = 0  # a place after the end sees nothing, not the next text
        r = r.reshape(b - a, BLOCK, FILTERS)
        if arg:
            w = r.argmax(axis=1)
            where[a:b] = w + (np.arange(a, b) * BLOCK)[:, None]
            top[a:b] = np.take_along_axis(r, w[:, None, :], axis=1)[:, 0]
        else:
            r.max(axis=1, out=top[a:b])
    return top, where


def chunk_pairs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first block, last block, chunks of each text): one chunk per adjacent pair of blocks,
    a single block is a chunk of its own."""
    m = np.maximum(1, n - 1)
    first = np.repeat(np.cumsum(n) - n - (np.cumsum(m) - m), m) + np.arange(m.sum())
    return first, first + np.repeat((n > 1).astype(np.int64), m), m


def forward(model: dict, top: np.ndarray, n: np.ndarray):
    first, last, m = chunk_pairs(n)
    pooled = np.maximum(top[first], top[last])
    at = np.cumsum(m) - m
    vec = np.concatenate((np.add.reduceat(pooled, at) / m[:, None], np.maximum.reduceat(pooled, at),
                          np.minimum.reduceat(pooled, at)), axis=1)
    hidden = np.maximum(vec @ model["w1"] + model["b1"], 0)
    z = hidden @ model["w2"] + model["b2"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), vec, hidden, pooled, (first, last, m, at)


def new_model(seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32)
    table[:, PAD] = 0
    return {"table": table, "w1": rng.normal(0, 0.1, (3 * FILTERS, HIDDEN)).astype(np.float32),
            "b1": np.full(HIDDEN, 0.05, np.float32), "w2": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
            "b2": np.zeros((), np.float32)}


def gradients(model: dict, raw: np.ndarray, off: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean log loss over one mini-batch of whole texts."""
    values, n = blocks(raw, off)
    top, where = convolve(model["table"], values, arg=True)
    p, vec, hidden, pooled, (first, last, m, at) = forward(model, top, n)
    dz = ((p - y) / len(y)).astype(np.float32)
    dh = np.outer(dz, model["w2"]) * (hidden > 0)
    dv = dh @ model["w1"].T
    own, F_ = common.owners(m), FILTERS
    mean, high, low = dv[:, :F_], dv[:, F_:2 * F_], dv[:, 2 * F_:]
    is_high = pooled == vec[own, F_:2 * F_]
    is_low = pooled == vec[own, 2 * F_:]
    dp = mean[own] / m[own][:, None]
    dp = dp + is_high * (high / np.maximum(1, np.add.reduceat(is_high, at, dtype=np.float32)))[own]
    dp = dp + is_low * (low / np.maximum(1, np.add.reduceat(is_low, at, dtype=np.float32)))[own]
    left = top[first] >= top[last]
    place = np.where(left, where[first], where[last])
    filt = np.broadcast_to(np.arange(F_), place.shape)
    g = np.zeros(WIDTH * 257 * F_, np.float32)
    for k in range(WIDTH):
        flat = ((k * 257) + values[place + k].astype(np.int64)) * F_ + filt
        g += np.bincount(flat.ravel(), weights=(dp * (values[place] != PAD)).ravel(), minlength=len(g)).astype(np.float32)
    g = g.reshape(WIDTH, 257, F_)
    g[:, PAD] = 0
    return {"table": g, "w1": vec.T @ dh, "b1": dh.sum(axis=0), "w2": hidden.T @ dz, "b2": dz.sum()}


def train(texts: list[bytes], y: np.ndarray, steps: int = 1800, batch: int = 32, rate: float = 3e-3, seed: int = 7) -> dict:
    """``steps`` of Adam over shuffled mini-batches; deterministic for the same texts in the same order."""
    model, rng = new_model(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    done = 0
    while done < steps:
        mix = rng.permutation(len(texts))
        for a in range(0, len(mix), batch)[:steps - done]:
            own = mix[a:a + batch]
            joined = [texts[i] for i in own]
            off = np.concatenate(([0], np.cumsum([len(t) for t in joined])))
            g = gradients(model, np.frombuffer(b"".join(joined), np.uint8), off, y[own])
            done += 1
            now = rate * (1 - done / (steps + 1))
            for k in model:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                model[k] = (model[k] - now * (first[k] / (1 - 0.9 ** done))
                            / (np.sqrt(second[k] / (1 - 0.99 ** done)) + 1e-8)).astype(np.float32)
    return model


def score_batch(model: dict, col: pa.Array) -> np.ndarray:
    raw, off = common.text_buffer(col)
    values, n = blocks(raw, off)
    return forward(model, convolve(model["table"], values)[0], n)[0].astype(np.float64)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null id: null)."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5))


def sample(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int], max_bytes: int,
           label: str = "quality") -> DataFrame:
    """At most ``max_rows`` labelled training texts of label 0 and of 1, by least hash of the id."""
    known = (labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("y in (0, 1)")
             .where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.min("y").alias("y")))
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    ids = known.where("y = 0").orderBy(order, "doc_id").limit(max_rows[0]).unionAll(
        known.where("y = 1").orderBy(order, "doc_id").limit(max_rows[1]))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ids: at most sum(max_rows) rows of 12 bytes
    return (texts.where(F.octet_length("text") <= max_bytes).join(F.broadcast(ids), "doc_id")
            .dropDuplicates(["doc_id"]).select("doc_id", "y", "text"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: tuple[int, int] = (2500, 5000), max_bytes: int = 1 << 16,
        steps: int = 1800) -> dict:
    """The trained model; it is trained by one task on the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, y, t) for b in batches for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        y = np.array([r[1] for r in rows], np.float32)
        model = train([r[2].encode() for r in rows], y, steps) if 0 < y.sum() < len(y) else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    got = sample(docs, labels, max_rows, max_bytes).repartition(1).mapInArrow(run, "model binary").first()
    model = pickle.loads(got["model"]) if got else None
    if model is None:
        model = new_model()
        model["w2"] = np.zeros_like(model["w2"])
    return model


def scored(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a probability of quality in ``out`` (an equally named column is replaced)."""
    docs = docs.drop(out) if out in docs.columns else docs
    schema = docs.schema.fields
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", `{out}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in common.slices(big, text):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score_batch(model, b.column(text)))],
                                                 [*b.schema.names, out])

    return docs.mapInArrow(run, kinds)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training) -> DataFrame:
    """The documents scored at or above the threshold, with the columns of ``docs``."""
    own, = common.fresh(docs.columns, "_score")
    got = scored(docs, fit(docs, labels, **training), out=own)
    return got.where(F.col(own) >= threshold).select(*[f"`{c}`" for c in docs.columns])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held.alias("held_out"), "score",
                                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
