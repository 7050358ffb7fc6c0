"""Operator 10: near-duplicate detection by ProbMinHash, banding and verification.

Every distinct word sequence is one class of copies, represented by its least id. The five-word
shingles of a representative are weighted by how often they occur in it. Each shingle is a
Poisson process of that rate: its arrivals (exponential gaps from a generator seeded by the
shingle) are thrown into random registers, and a register keeps the shingle of its earliest
arrival. A shingle stops at its first arrival later than the latest register. Two texts agree
in a register with probability equal to their probability Jaccard similarity

    J_P(x, y) = sum over d of 1 / sum over e of max(x_e / x_d, y_e / y_d),

which is the Jaccard similarity when no shingle repeats. Signatures are cut into bands; texts
that share a band are candidates and the exact J_P of their shingles decides (>= 0.8).

A band's bucket of any size is worked in two rounds and never lists all its pairs. Round one
compares each member with the bucket's hub, the member that shares the largest buckets over
all bands (of a group of copies with edits that is the text nearest to all). Round two takes
the buckets whose members are not yet in one component, and compares members of different
components only, those whose signatures agree in so many registers that the threshold is within
``MARGIN`` standard deviations, each pair in the first band it shares; members already joined need no further link, so no
link between different components is lost. A bucket's members are dealt to cells of bounded size, a task compares two cells.

Edge cases: a null text is empty; texts without words link with nothing and are kept; a null
id is left out of groups and kept; equal ids are one document (least text); ties go to the least id; an empty table gives
no rows; other columns are ignored (kept by ``drop_near_duplicates``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.broadcast import sized_broadcast
from quarry.llm import common

THRESHOLD = 0.8
#: A pair at the threshold shares none of 64 bands of 8 registers with probability 0.000008; one at 0.4 shares one with 0.04.
BANDS, ROWS = 64, 8
#: Members of one cell of a bucket that meet in a task.
CELL = 1024
#: Standard deviations of the register estimate below the threshold that are still verified (a pair at it is lost with 0.000001).
MARGIN = 5.0
#: Arrivals that a shingle throws at once, and all shingles of a slice together, at most (one each at least).
AHEAD, ARRIVALS = 64, 1 << 16
#: Text bytes and rows of a slice that is signed at once: its hashes take about 50 times the bytes in a worker.
SIGN_BYTES, SIGN_ROWS = 1 << 20, 2048
_NONE = np.uint64(0)


def exponential(h: np.ndarray, arrival: int) -> np.ndarray:
    """Standard exponential number of each element's given arrival."""
    u = (common.mix64(h ^ np.uint64((2 * arrival + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(11))
    return -np.log((u.astype(np.float64) + 0.5) / 2.0 ** 53)


def weighted(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, distinct shingle, weight) sorted by text and shingle."""
    own = common.owners(counts)
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(first)
    return own[at], h[at], np.diff(np.append(at, len(h))).astype(np.float64)


def signatures(own: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """(n, size) register contents: 16 bits of the winning shingle's hash (0 for a text without any);
    bits that agree by chance only add candidates, which the exact similarity decides."""
    time = np.full(n * size, np.inf)
    win = np.full(n * size, _NONE)
    now = np.zeros(len(h))
    live, arrival = np.arange(len(h)), 0
    while len(live):
        # few shingles are left when short texts fill their registers: each throws several arrivals at once
        ahead = max(1, min(AHEAD, ARRIVALS // len(live)))
        gaps = np.stack([exponential(h[live], arrival + a) / weight[live] for a in range(ahead)], 1)
        gaps[:, 0] += now[live]
        at = np.cumsum(gaps, axis=1)
        reg = np.stack([common.mix64(h[live] + np.uint64((arrival + a + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
                        % np.uint64(size) for a in range(ahead)], 1).astype(np.int64) + own[live, None] * size
        soon = at < time[reg]
        reg, when, who = reg[soon], at[soon], np.broadcast_to(live[:, None], at.shape)[soon]
        np.minimum.at(time, reg, when)
        won = time[reg] == when
        win[reg[won]] = h[who[won]]
        now[live] = at[:, -1]
        arrival += ahead
        # early termination, by the latest register of the texts that still throw
        edge = np.flatnonzero(np.append(True, own[live[1:]] != own[live[:-1]]))
        latest = time.reshape(n, size)[own[live[edge]]].max(axis=1)
        live = live[now[live] < np.repeat(latest, np.diff(np.append(edge, len(live))))]
    return (win >> np.uint64(48)).astype(np.uint16).reshape(n, size)


def similarity(h1, w1, h2, w2) -> float:
    """Exact J_P of two weighted sets given by sorted distinct hashes and weights."""
    if not len(h1) or not len(h2):
        return 0.0
    both = np.union1d(h1, h2)
    x, y = np.zeros(len(both)), np.zeros(len(both))
    x[np.searchsorted(both, h1)], y[np.searchsorted(both, h2)] = w1, w2
    common_ = (x > 0) & (y > 0)
    if not common_.any():
        return 0.0
    # sum_e max(x_e / x_d, y_e / y_d): e counts by x where x_e / y_e > x_d / y_d
    ratio = np.where(y > 0, x / np.where(y > 0, y, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    r, cx, cy = ratio[order], np.cumsum(x[order][::-1])[::-1], np.cumsum(y[order])
    d = np.flatnonzero(common_)
    k = np.searchsorted(r, ratio[d], side="right")
    above = np.append(cx, 0.0)[k]
    below = np.concatenate(([0.0], cy))[k]
    return float((1.0 / (above / x[d] + below / y[d])).sum())


def sign(big: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """(id, copy, sig) of a batch (id, text), a slice at a time."""
    for b in common.slices(big, limit=SIGN_BYTES, rows=SIGN_ROWS):
        words, counts = common.words(*common.text_buffer(b.column("text")))
        at = np.cumsum(counts) - counts
        own = common.owners(counts)
        place = np.arange(len(words)) - np.repeat(at, counts)
        parts = [np.add.reduceat(np.append(common.mix64(words ^ common.mix64(place.astype(np.uint64) + np.uint64(s))),
                                           np.uint64(0)), at) if len(at) else at for s in (1, 1 << 32)]
        h, n = common.shingles(words, counts)
        sig = signatures(*weighted(h, n), b.num_rows, size)
        none = counts == 0
        copy = [None if z else x.tobytes() for z, x in zip(none, np.stack(parts, 1), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(copy, pa.binary()),
             pa.array([None if z else x.tobytes() for z, x in zip(none, sig, strict=True)], pa.binary())],
            ["id", "copy", "sig"])


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, copy (hash of the word sequence), signature of ``docs(doc_id, text)``; the
    signature is null for a text without words."""
    size = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            yield from sign(big, size)

    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"),
                                                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(run, "id long, copy binary, sig binary")


def banded(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, band, id) of every band of every representative."""
    width = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * width + 1, F.lit(width))))
    return reps.select("id", F.posexplode(keys).alias("band", "bucket"))


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold. Texts join by key; a
    hub's text is joined to its pairs in split partitions (AQE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in common.slices(big, "ta", 1 << 20):
                sets = []
                for name in ("ta", "tb"):
                    own, h, w = weighted(*common.text_shingles(b.column(name)))
                    cut = np.searchsorted(own, np.arange(b.num_rows + 1))
                    sets.append([(h[i:j], w[i:j]) for i, j in zip(cut, cut[1:], strict=False)])
                good = [similarity(*x, *y) >= threshold - 1e-12 for x, y in zip(*sets, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good)), b.column("b").filter(pa.array(good))],
                                                 ["a", "b"])

    t = texts.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    need = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    # the ids of paired texts are broadcast where they are few (a count decides): no text is shuffled then
    t = common.stored(t.join(sized_broadcast(need), "id", "left_semi").groupBy("id").agg(F.min("t").alias("t")), "pair-texts")
    joined = (pairs.join(t.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
              .join(t.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b"))
    links = common.stored(joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "pair-links")
    common.discard(t)
    return links


def cross_pairs(members: DataFrame, bands: int, rows: int, least: float) -> DataFrame:
    """Pairs of members (bucket, band, id, component, sig) of one bucket in different components
    whose signatures agree in a share ``least`` of the registers, each in the first band it
    shares. A bucket is dealt to cells and two cells meet in a task."""
    size = bands * rows
    cells = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "bucket", F.ceil(F.col("_n") / CELL).cast("int").alias("_cells"))
    dealt = members.join(cells, "bucket").withColumn("_c", F.pmod(F.xxhash64("id"), F.col("_cells")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("_cells") - 1),
                       lambda o: F.struct(F.least("_c", o).alias("x"), F.greatest("_c", o).alias("y")))
    met = dealt.withColumn("_m", F.explode(meet)).select("bucket", "band", "_m.x", "_m.y", "_c", "id", "component", "sig")
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        x, y, band = (t.column(c)[0].as_py() for c in ("x", "y", "band"))
        cell, ids, comp = (np.asarray(t.column(c)) for c in ("_c", "id", "component"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), size)
        left, right = np.flatnonzero(cell == x), np.flatnonzero(cell == y)
        a, b = [], []
        for i in left:
            j = right[(comp[right] != comp[i]) & ((ids[right] > ids[i]) if x == y else True)]
            same = sig[j] == sig[i]
            first = same.reshape(len(j), bands, rows).all(axis=2).argmax(axis=1)
            j = j[(same.mean(axis=1) >= least) & (first == band)]
            a.append(np.minimum(ids[i], ids[j]))
            b.append(np.maximum(ids[i], ids[j]))
        return pa.table([np.concatenate(a or [ids[:0]]), np.concatenate(b or [ids[:0]])], schema=kinds)

    return met.groupBy("bucket", "x", "y").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id (least id of texts joined by links), rep_id (least id of equal word
    sequences) for every document with an id."""
    texts = docs.select("doc_id", "text")
    s = common.stored(signed(texts, bands, rows), "signatures")
    copies = s.where("copy is not null").groupBy("copy").agg(F.min("id").alias("rep"))
    member = common.stored(s.select("id", "copy").join(copies, "copy").select("id", "rep")
                           .groupBy("id").agg(F.min("rep").alias("rep")), "copies")
    reps = common.stored(s.join(copies, (s["copy"] == copies["copy"]) & (s["id"] == copies["rep"]))
                         .select("id", "sig").dropDuplicates(["id"]), "representatives")
    buckets = banded(reps, bands, rows)
    # round one: every member with the hub of its bucket
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = common.stored(buckets.join(sizes, "bucket"), "shared-bands")
    wide = shared.groupBy("id").agg(F.sum("n").alias("wide"))
    hubs = (shared.select("bucket", "id").join(wide, "id").groupBy("bucket")
            .agg(F.max(F.struct("wide", (-F.col("id")).alias("last"))).alias("h")).select("bucket", (-F.col("h.last")).alias("hub")))
    pairs = shared.join(hubs, "bucket").where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    pairs = common.stored(pairs.distinct(), "star-pairs")
    links = verified(pairs, texts, threshold)
    joined = common.components(links)
    # round two: members of one bucket that are in different components
    named = (shared.select("bucket", "band", "id").join(joined, "id", "left")
             .withColumn("component", F.coalesce("component", "id")))
    open_ = (named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where("lo < hi").select("bucket"))
    members = common.stored(named.join(open_, "bucket", "left_semi").join(reps, "id"), "open-buckets")
    least = threshold - MARGIN * (threshold * (1 - threshold) / (bands * rows)) ** 0.5
    more = cross_pairs(members, bands, rows, least).join(pairs, ["a", "b"], "left_anti")
    more = common.stored(more, "cross-pairs")
    links2 = verified(more, texts, threshold)
    joined = common.components(links.unionAll(links2))
    named = (member.join(joined.withColumnRenamed("id", "rep"), "rep", "left")
             .select("id", "rep", F.coalesce("component", "rep").alias("class_id")))
    alone = s.where("copy is null").select("id", F.col("id").alias("rep"), F.col("id").alias("class_id"))
    alone = common.stored(alone.distinct().join(member.select("id"), "id", "left_anti"), "without-words")
    # all that the result reads is stored
    common.discard(s, reps, shared, pairs, members, more, links, links2)
    return named.unionAll(alone).select(F.col("id").alias("doc_id"), "class_id", F.col("rep").alias("rep_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each class (the least id; of equal ids the least text), with the
    columns of ``docs``; rows with a null id are kept."""
    from pyspark.sql import Window
    kept_id, own_id, number = common.fresh(docs.columns, "_kept", "_id", "_n")
    kept = near_duplicates(docs, **options).where("doc_id = class_id").select(F.col("doc_id").alias(kept_id))
    own = docs.withColumn(own_id, F.col("doc_id").cast("long"))
    got = own.join(kept, F.col(own_id) == F.col(kept_id), "left_semi")
    first = Window.partitionBy(own_id).orderBy("text")
    got = got.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1)
    return got.select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(
        docs.where("doc_id is null").select(*[F.col(f"`{c}`") for c in docs.columns]))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(common.table(spark, sf_dir, "documents"))
    return got.withColumn("kept", F.col("doc_id") == F.col("class_id"))
