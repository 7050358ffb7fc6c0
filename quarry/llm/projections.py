"""Operator 4: near-duplicate vectors by collision-counting projections.

Many one-dimensional random projections are sorted. A unit vector keeps the ``keep`` signed
projections on which it lies farthest out: there the line is sparsely populated and a
query-centred window of half width ``window`` holds few unlike vectors, while a vector of
cosine c lies within it with known probability. Two vectors collide on a projection that both
keep, inside the window; pairs with at least ``hits`` collisions are verified by cosine in
double precision. ``hits`` is calibrated: the largest count which keeps the recall of pairs at
exactly the threshold at ``recall`` or more, measured on random pairs of that cosine under
the same projections (fixed seed). Where even one collision does not reach it (few dimensions), vectors keep twice as many
projections until it does. The number of projections grows with the number of
vectors, so that a sorted line keeps about ``LINE`` vectors.

Each vector carries the list of its lines, so a task that holds a line counts a pair's
collisions itself and works the pair only on the first line they share: every pair is counted and verified once
and no pair is shuffled. A line of any length is dealt to cells of ``CELL`` vectors, two of which meet in a task.
Equal vectors are one class beforehand; their links are counted by multiplicity. A task
reports its vectors' link counts and, instead of all links, a spanning forest of them.

Vectors of each length are compared among themselves, one pass for each length that two different vectors have.

Edge cases: null, zero and non-finite vectors link with nothing, vectors of different lengths not with each other; a null
id is dropped; rows of one id are one vector (the least); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

THRESHOLD, RECALL = 0.95, 0.995
KEEP, LINE, CELL = 12, 48, 512
LEAST_PROJECTIONS, MOST_PROJECTIONS = 256, 1 << 15
LINKS = "id long, other long, links long"


def directions(dims: int, count: int, seed: int = 11) -> np.ndarray:
    """``count`` random unit directions, times sqrt(dims): a projection of a random unit
    vector has variance one."""
    d = np.random.default_rng(seed).standard_normal((count, dims))
    return d / np.linalg.norm(d, axis=1, keepdims=True) * np.sqrt(dims)


def half_width(threshold: float) -> float:
    """Four standard deviations of the difference of two projections at the threshold."""
    return 4.0 * float(np.sqrt(2 - 2 * threshold))


def outermost(x: np.ndarray, d: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(signed line numbers, places on them) of each row's outermost projections."""
    y = x @ d.T
    size = np.abs(y)
    k = min(keep, y.shape[1])
    at = np.argpartition(-size, k - 1, axis=1)[:, :k]
    at.sort(axis=1)
    y = np.take_along_axis(y, at, axis=1)
    return (2 * at + (y < 0)).astype(np.int32), np.abs(y).astype(np.float32)


def collisions(l1, y1, l2, y2, window: float) -> tuple[np.ndarray, np.ndarray]:
    """(collisions, first common line or -1) of row i of the first with row i of the second."""
    hit = (l1[:, :, None] == l2[:, None, :]) & (np.abs(y1[:, :, None] - y2[:, None, :]) <= window)
    some = hit.any(axis=2)
    line = np.where(some.any(axis=1), np.take_along_axis(l1, some.argmax(axis=1)[:, None], axis=1)[:, 0], -1)
    return hit.sum(axis=(1, 2)), line


def calibrate(d: np.ndarray, threshold: float, keep: int, recall: float, pairs: int = 20_000, seed: int = 5) -> tuple[int, float]:
    """(largest collision count of at least the wanted recall, or one, and the recall it has) on random
    pairs whose cosine is exactly the threshold; in one dimension, which has no such pairs, one collision."""
    rng, dims = np.random.default_rng(seed), d.shape[1]
    if dims == 1:
        return 1, 1.0
    counts = []
    for _ in range(0, pairs, 250):
        a, b = rng.standard_normal((2, 250, dims))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(axis=1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = threshold * a + np.sqrt(1 - threshold ** 2) * b
        on = np.full((2, 250, 2 * len(d)), np.nan, np.float32)  # places by signed line
        for row, x in zip(on, (a, b), strict=True):
            line, y = outermost(x, d, keep)
            np.put_along_axis(row, line.astype(np.int64), y, axis=1)
        counts.append((np.abs(on[0] - on[1]) <= half_width(threshold)).sum(axis=1))
    counts = np.concatenate(counts)
    hits = 1
    while (counts >= hits + 1).mean() >= recall:
        hits += 1
    return hits, float((counts >= hits).mean())


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double> or null if it cannot link), one row per id."""
    v = F.col(vec_col).cast("array<double>")
    bad = v.isNull() | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists(v, lambda x: x != 0)
    return (vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(~bad, v).alias("v"))
            .groupBy("id").agg(F.min("v").alias("v")))


def settings_for(n: int, dims: int, threshold: float, keep: int, recall: float) -> tuple[int, int, int]:
    """(projections, projections kept by a vector, collisions asked for) for ``n`` vectors; the recall at the threshold is reached."""
    m = int(np.clip(2 ** np.ceil(np.log2(max(1, n * keep / (2 * LINE)))), LEAST_PROJECTIONS, MOST_PROJECTIONS))
    d = directions(dims, m)
    while True:
        keep = min(keep, m)
        hits, got = calibrate(d, threshold, keep, recall)
        if got >= recall:
            return m, keep, hits
        if keep == m:
            raise ValueError(f"{m} projections of {dims} dimensions reach a recall of {got} only")
        keep *= 2


def links_of_length(classes: DataFrame, dims: int, n: int, threshold: float, keep: int, recall: float) -> DataFrame:
    """id, other, links of the ``n`` classes (rep, copies, v) whose vectors have ``dims`` components: link counts and a
    spanning forest."""
    m, keep, hits = settings_for(n, dims, threshold, keep, recall)
    width = half_width(threshold)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = directions(dims, m)
        for big in batches:
            for a in range(0, big.num_rows, 512):
                b = big.slice(a, 512)
                x = np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, dims)
                x = x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)
                line, y = outermost(x, d, keep)
                yield pa.RecordBatch.from_arrays(
                    [b.column("rep"), b.column("copies"), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array([r.tobytes() for r in y], pa.binary()), pa.array(line.tolist(), pa.list_(pa.int32()))],
                    ["rep", "copies", "x", "y", "lines"])

    placed = common.stored(classes.mapInArrow(project, "rep long, copies long, x binary, y binary, lines array<int>"), "projected")
    cells = (placed.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("line", F.ceil(F.col("n") / CELL).cast("int").alias("cells")))
    on = placed.withColumn("line", F.explode("lines")).join(cells, "line")
    on = on.withColumn("c", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.col("cells") - 1),
                       lambda o: F.struct(F.least("c", o).alias("p"), F.greatest("c", o).alias("q")))
    met = on.withColumn("m", F.explode(meet)).select("line", "m.p", "m.q", "c", "rep", "copies", "x", "y", "lines")
    kinds = pa.schema([("id", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])

    def link(t: pa.Table) -> pa.Table:
        line, p, q = (t.column(c)[0].as_py() for c in ("line", "p", "q"))
        t = t.combine_chunks()
        rep, copies, cell = (np.asarray(t.column(c)) for c in ("rep", "copies", "c"))
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(len(rep), dims)
        k = len(t.column("lines")[0])
        y = np.frombuffer(b"".join(t.column("y").to_pylist()), np.float32).reshape(len(rep), k)
        lines = np.asarray(t.column("lines").combine_chunks().flatten()).reshape(len(rep), k)
        here = np.where(lines == line, y, 0).sum(axis=1)  # place on this line
        order = np.lexsort((rep, here))
        left, right = order[cell[order] == p], order[cell[order] == q]
        lo = np.searchsorted(here[right], here[left] - width, side="left")
        hi = np.searchsorted(here[right], here[left] + width, side="right")
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, a, b in zip(left.tolist(), lo.tolist(), hi.tolist(), strict=True):
            j = right[a:b]
            j = j[rep[j] > rep[i]] if p == q else j
            if not len(j):
                continue
            count, first = collisions(np.broadcast_to(lines[i], (len(j), k)), np.broadcast_to(y[i], (len(j), k)),
                                      lines[j], y[j], width)
            j = j[(first == line) & (count >= hits)]
            if not len(j):
                continue
            j = j[np.einsum("ij,j->i", x[j], x[i]) >= threshold]
            links[i] += copies[j].sum()
            links[j] += copies[i]
            for e in j.tolist():
                u, v = find(i), find(e)
                if u != v:
                    root[max(u, v, key=lambda z: rep[z])] = min(u, v, key=lambda z: rep[z])
        own = np.flatnonzero(links)
        head = np.array([rep[find(i)] for i in own.tolist()], np.int64)
        return pa.table([rep[own], head, links[own]], schema=kinds)

    found = common.stored(met.groupBy("line", "p", "q").applyInArrow(link, LINKS), "vector-links")
    common.discard(placed)
    return found


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                 keep: int = KEEP, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    all_ = common.stored(usable(vectors, id_col, vec_col), "vectors")
    classes = (all_.where("v is not null").groupBy("v")
               .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("dims", F.size("v")))
    classes = common.stored(classes, "vector-classes")
    lengths = sorted(classes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).where("n > 1").collect())
    found = all_.sparkSession.createDataFrame([], LINKS)
    for dims, n in lengths:
        one = links_of_length(classes.where(F.col("dims") == dims).drop("dims"), dims, n, threshold, keep, recall)
        found = one if len(lengths) == 1 else found.unionAll(one)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = common.components(found.where("id != other"), "id", "other")
    reps = (classes.select("v", "rep", "copies").join(links, F.col("rep") == F.col("id"), "left").drop("id")
            .join(joined, F.col("rep") == F.col("id"), "left")
            .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                    F.coalesce("component", "rep").alias("component_id")))
    got = all_.join(reps, "v", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").cast("long").alias("component_id"))
    return got.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op4_collision_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
