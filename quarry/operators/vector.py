"""Embedding and vector search.

E1  ``hash_embed``: the built-in encoder, signed feature hashing of the B1 tokens into
    ``dim`` buckets (md5 of the token: first 8 hex digits -> bucket, 9th digit -> sign),
    summed and L2-normalised, all JVM-side. A real sentence encoder plugs in through
    :func:`model_embed` (``predict_batch_udf``, Arrow batches, model loaded once per worker).
E2  ``sq_l2``: squared Euclidean distance (the vector store's default metric);
    ``cosine`` distance as an option.
E3  ``vector_topk``: exact k nearest chunks per question within its domain. The corpus
    of a domain is cut into blocks of ``block_rows`` rows, questions into blocks of
    ``query_block_rows``; each (domain, corpus block, question block) is one cogroup
    task that computes the distance matrix with numpy and emits only its local top k
    per question. A final row_number filter (partial WindowGroupLimit) keeps the global
    top k. No row pairs are ever materialised, no group holds more than a block, and
    nothing passes through the driver.
E4  ``vector_topk_cells``: approximate search over k-means cells; a question probes its
    nearest cells within its domain and is re-ranked exactly by the kernel of E3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.broadcast import dim_broadcast
from quarry.functions.text import tokenize

DIM = 64
#: Vector values of a question batch up to which every Python worker holds all of it (32 MB) and a running top k.
BROADCAST_VALUES = 4_000_000


def _hash_parts(tok: Column):
    h = F.md5(tok)
    bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") < 8, F.lit(1)).otherwise(F.lit(-1))
    return bucket, sign


def hash_embed(df: DataFrame, key_cols: list[str], text_col: str, dim: int = DIM,
               out: str = "embedding") -> DataFrame:
    """(key_cols..., embedding array<double>) for each row of ``df``.

    Tokens are exploded (narrow), each hashed to a signed bucket; one aggregation per
    (row key, bucket) sums the signs (partial aggregation map-side), a second gathers at
    most ``dim`` (bucket, value) entries per row key into the dense, L2-normalised
    vector. Blank text gives the zero vector.
    """
    t = df.select(*key_cols, F.explode_outer(tokenize(text_col)).alias("_tok"))
    bucket, sign = _hash_parts(F.col("_tok"))
    t = t.select(*key_cols,
                 F.when(F.col("_tok").isNull(), F.lit(-1).cast("long"))
                  .otherwise(F.pmod(bucket, F.lit(dim))).alias("_bk"),
                 F.when(F.col("_tok").isNull(), F.lit(0)).otherwise(sign).alias("_sg"))
    return _dense_from_buckets(t, key_cols, dim, out)


#: Tokens that :func:`with_terms` works on at once (a longer text: all of its own).
SLICE_TOKENS = 1 << 18


def _word_buckets(words: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each word, as :func:`_hash_parts`."""
    d = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:5] for w in words), np.uint8).reshape(-1, 5)
    head = np.ascontiguousarray(d[:, :4]).view(">u4").ravel().astype(np.int64)
    return head % dim, np.where(d[:, 4] < 128, 1.0, -1.0)


def _terms_of(tokens: pa.Array, dim: int) -> pa.StructArray:
    """Distinct terms with counts, and the hash vector, of each row's tokens."""
    n = len(tokens)
    lens = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
    coded = tokens.flatten().dictionary_encode()
    words = coded.dictionary
    own = np.repeat(np.arange(n), lens)
    each, f = np.unique(own * max(1, len(words)) + np.asarray(coded.indices, np.int64), return_counts=True)
    row, code = np.divmod(each, max(1, len(words)))
    terms = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()),
        pa.StructArray.from_arrays([words.take(pa.array(code)), pa.array(f, pa.int64())], ["term", "f"]))
    bucket, sign = _word_buckets(words.to_pylist(), dim)
    sums = np.bincount(row * dim + bucket[code], sign[code] * f, n * dim).reshape(n, dim)
    norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    vec = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), 0.0)
    vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(vec.ravel()))
    return pa.StructArray.from_arrays([terms, vec], ["terms", "vec"])


def _packed(got: pa.StructArray) -> pa.StructArray:
    """Of :func:`_terms_of`: the terms of a row as one text (a token holds no space), their counts as an array."""
    terms = got.field("terms")
    words = pc.binary_join(pa.ListArray.from_arrays(terms.offsets, terms.values.field("term")), " ")
    f = pa.ListArray.from_arrays(terms.offsets, terms.values.field("f").cast(pa.int32()))
    return pa.StructArray.from_arrays([pa.StructArray.from_arrays([words, f], ["words", "f"]), got.field("vec")], ["terms", "vec"])


def with_terms(df: DataFrame, text_col: str, dim: int = DIM, packed: bool = False) -> DataFrame:
    """Add row by row, moving none: the tokens' number ``dl`` (null for a null text), the distinct terms with counts
    ``terms`` array<struct<term, f>> and the hash vector ``vec`` of :func:`hash_embed`. Tokens are cut by the JVM; a batch's
    distinct words are hashed once. ``packed``: ``terms`` is struct<words, f>, the words in one text and their counts, for rows
    that are moved or kept (a row's array of structs takes some 50 bytes a term besides its letters)."""
    pack, kind = (_packed, "struct<words:string,f:array<int>>") if packed else (lambda got: got, "array<struct<term:string,f:bigint>>")

    @F.arrow_udf(f"struct<terms:{kind},vec:array<double>>")
    def terms(tokens: pa.Array) -> pa.Array:
        lens = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int64)
        part = (np.cumsum(lens) - lens) // SLICE_TOKENS
        cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(tokens)) if len(tokens) else [0, 0]
        return pa.concat_arrays([pack(_terms_of(tokens.slice(x, y - x), dim)) for x, y in zip(cuts, cuts[1:], strict=False)])

    t = df.withColumn("__t", tokenize(text_col))
    return (t.withColumn("__c", terms("__t")).withColumns(
        {"dl": F.size("__t").cast("long"), "terms": F.col("__c.terms"), "vec": F.col("__c.vec")}).drop("__t", "__c"))


def _dense_from_buckets(t: DataFrame, key_cols: list[str], dim: int, out: str) -> DataFrame:
    per_bucket = t.groupBy(*key_cols, "_bk").agg(F.sum("_sg").cast("double").alias("_v"))
    per_row = per_bucket.groupBy(*key_cols).agg(
        F.map_from_entries(F.collect_list(F.struct("_bk", "_v"))).alias("_m"),
        F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"))
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")),
                        lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    return per_row.select(
        *key_cols,
        F.when(F.col("_norm") > 0, F.transform(dense, lambda x: x / F.col("_norm")))
         .otherwise(F.array_repeat(F.lit(0.0), dim)).alias(out))


def model_embed(df: DataFrame, text_col: str, make_model, dim: int, out: str = "embedding",
                batch_size: int = 256) -> DataFrame:
    """Embed with a user-supplied encoder. ``make_model()`` runs once per Python
    worker and returns ``f(np.ndarray[str]) -> np.ndarray[float, (n, dim)]``."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    def make_predict():
        model = make_model()

        def predict(texts: np.ndarray) -> np.ndarray:
            got = np.asarray(model(texts), dtype=np.float64)
            if got.shape != (len(texts), dim):
                raise ValueError(f"the encoder returned {got.shape}, not {(len(texts), dim)}")
            return got
        return predict

    udf = predict_batch_udf(make_predict, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return df.withColumn(out, udf(F.col(text_col)))


def encoder(make_model, dim: int, batch_size: int = 256):
    """Adapter for :func:`quarry.plans.search.build_collection` / ``hybrid_search``:
    returns ``embed(df, key_cols, text_col) -> (key_cols..., vector)``, naming the vector
    ``vec`` for chunks and ``qvec`` for questions."""
    def embed(df: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
        out = "qvec" if "question_id" in key_cols else "vec"
        e = model_embed(df.select(*key_cols, text_col), text_col, make_model, dim, out=out, batch_size=batch_size)
        return e.select(*key_cols, out)
    return embed


def sq_l2(a, b) -> Column:
    """Squared L2 distance of two array columns, in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))
                                  * (x.cast("double") - y.cast("double"))),
                       F.lit(0.0), lambda acc, v: acc + v)


def cosine_distance(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                      lambda acc, v: acc + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    # a zero vector is at distance 1 from everything
    return F.when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(F.lit(1.0) - F.try_divide(dot, na * nb))


_TOPK_SCHEMA = "question_id long, domain string, chunk_pos long, distance double"


def _block_topk_fn(k: int, digits: int | None, metric: str, exclude_self: bool):
    def fn(key, corpus: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if corpus.empty or qs.empty:
            return pd.DataFrame({"question_id": pd.Series([], dtype="int64"),
                                 "domain": pd.Series([], dtype="object"),
                                 "chunk_pos": pd.Series([], dtype="int64"),
                                 "distance": pd.Series([], dtype="float64")})
        C = np.stack(corpus["vec"].to_numpy()).astype(np.float64)
        pos = corpus["chunk_pos"].to_numpy(dtype=np.int64)
        Q = np.stack(qs["qvec"].to_numpy()).astype(np.float64)
        qid = qs["question_id"].to_numpy(dtype=np.int64)
        self_pos = qs["self_pos"].to_numpy(dtype=np.int64) if exclude_self else None
        q, p, d = _local_topk(Q, qid, self_pos, C, pos, k, digits, metric)
        return pd.DataFrame({"question_id": q, "domain": key[0], "chunk_pos": p, "distance": d})
    return fn


#: Distances that :func:`_local_topk` holds at once.
SLAB = 1_000_000


def _local_topk(Q, qid, self_pos, C, pos, k, digits, metric):
    """Top k (distance, chunk_pos) per question of one corpus slice, ties by position."""
    n = len(C)
    kk = min(k, n)
    slab = max(1, int(SLAB // max(1, n)))
    sq = np.einsum("ij,ij->i", C, C)
    out_q, out_p, out_d = [], [], []
    if metric == "cosine":
        cn = np.linalg.norm(C, axis=1, keepdims=True)
        Cn = C / np.where(cn == 0, 1, cn)
    for s in range(0, len(Q), slab):
        q = Q[s:s + slab]
        if metric == "cosine":
            qn = np.linalg.norm(q, axis=1, keepdims=True)
            dist = 1.0 - (q / np.where(qn == 0, 1, qn)) @ Cn.T
        else:
            # |q - c|^2 = |q|^2 + |c|^2 - 2 qc: one matrix product per slab of questions
            dist = np.einsum("ij,ij->i", q, q)[:, None] + sq[None, :]
            dist -= 2.0 * (q @ C.T)
            np.maximum(dist, 0.0, out=dist)
        if digits is not None:
            np.round(dist, digits, out=dist)
        if self_pos is not None:
            dist[pos[None, :] == self_pos[s:s + slab, None]] = np.inf
        thr = np.partition(dist, kk - 1, axis=1)[:, kk - 1]
        rows, cols = np.nonzero(dist <= thr[:, None])
        dv = dist[rows, cols]
        order = np.lexsort((pos[cols], dv, rows))
        rows, cols, dv = rows[order], cols[order], dv[order]
        first = np.searchsorted(rows, rows, side="left")
        keep = (np.arange(len(rows)) - first < kk) & np.isfinite(dv)
        out_q.append(qid[s:s + slab][rows[keep]])
        out_p.append(pos[cols[keep]])
        out_d.append(dv[keep])
    return np.concatenate(out_q), np.concatenate(out_p), np.concatenate(out_d)


def _scan_topk_fn(bc, k: int, digits: int | None, metric: str):
    """mapInPandas body: the broadcast question matrix per domain against the corpus rows
    of this partition; a running top k per question is kept across Arrow batches and
    emitted once per partition."""
    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qs = bc.value
        best: dict[str, tuple] = {}
        for pdf in batches:
            for dom, g in pdf.groupby("domain", sort=False):
                if dom not in qs:
                    continue
                qid, Q, self_pos = qs[dom]
                C = np.stack(g["vec"].to_numpy()).astype(np.float64)
                pos = g["chunk_pos"].to_numpy(dtype=np.int64)
                a = _local_topk(Q, qid, self_pos, C, pos, k, digits, metric)
                if dom in best:
                    b = best[dom]
                    merged = tuple(np.concatenate([x, y]) for x, y in zip(b, a))
                    order = np.lexsort((merged[1], merged[2], merged[0]))
                    mq, mp, md = (x[order] for x in merged)
                    first = np.searchsorted(mq, mq, side="left")
                    keep = np.arange(len(mq)) - first < k
                    a = (mq[keep], mp[keep], md[keep])
                best[dom] = a
        for dom, (q, p, d) in best.items():
            yield pd.DataFrame({"question_id": q, "domain": dom, "chunk_pos": p, "distance": d})
    return fn


def vector_candidates(queries: DataFrame, corpus: DataFrame, k: int = 10, digits: int | None = 6,
                      metric: str = "l2", exclude_self: bool = False, block_rows: int = 20_000,
                      query_block_rows: int = 20_000, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Local top k candidates per question (final cut by :func:`final_topk`).

    queries: (question_id, domain, qvec[, self_pos]); corpus: (domain, chunk_pos, vec).

    * Question batch proven small (rows x dims <= ``broadcast_values``): the question
      matrix is broadcast once per executor and the corpus is scanned where it lies
      (``mapInPandas``, no shuffle of the corpus), keeping a running top k per partition.
    * Otherwise: both sides are cut into blocks and every (domain, corpus block, question
      block) is one cogroup task; nothing passes through the driver.
    """
    qcols = ["question_id", "domain", "qvec"] + (["self_pos"] if exclude_self else [])
    # Kept only for the size check and the read below; the plan returned does not use it.
    q = queries.select(*qcols)
    ours = q.storageLevel == StorageLevel.NONE   # never drop a cache the caller owns
    if ours:
        q = q.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Exact size of the batch in vector values (one aggregate, one number back); only a
        # batch within the budget is brought to the driver for broadcasting.
        total = q.select(F.coalesce(F.sum(F.greatest(F.size("qvec"), F.lit(1))), F.lit(0))).first()[0]
        qpdf = q.toPandas() if total <= broadcast_values else None
    finally:
        if ours:
            q.unpersist()
    if qpdf is not None:
        packed = {}
        for dom, g in qpdf.groupby("domain", sort=False):
            packed[dom] = (g["question_id"].to_numpy(dtype=np.int64),
                           np.stack(g["qvec"].to_numpy()).astype(np.float64),
                           g["self_pos"].to_numpy(dtype=np.int64) if exclude_self else None)
        bc = queries.sparkSession.sparkContext.broadcast(packed)
        return (corpus.select("domain", "chunk_pos", "vec")
                      .mapInPandas(_scan_topk_fn(bc, k, digits, metric), _TOPK_SCHEMA))
    return _block_candidates(queries, corpus, k, digits, metric, exclude_self, block_rows, query_block_rows)


def _block_candidates(queries: DataFrame, corpus: DataFrame, k: int, digits: int | None, metric: str,
                      exclude_self: bool, block_rows: int, query_block_rows: int) -> DataFrame:
    """Blocked exact search: local top k of every (corpus block, question block) pair."""
    # Fresh attribute ids on both inputs, so a table searched against itself is no
    # ambiguous self-join.
    corpus = corpus.select(*[F.col(c).alias(c) for c in corpus.columns])
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])
    cstat = corpus.groupBy("domain").agg(F.count(F.lit(1)).alias("_n"))
    qstat = queries.groupBy("domain").agg(F.count(F.lit(1)).alias("_q"))
    # One row per domain present on both sides: bounded by the domain catalog.
    stat = dim_broadcast(
        cstat.join(qstat, "domain")
             .select("domain",
                     F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_rows))).cast("long").alias("_nb"),
                     F.greatest(F.lit(1), F.ceil(F.col("_q") / F.lit(query_block_rows))).cast("long").alias("_nq")))
    cb = (corpus.join(stat, "domain")
                .select("domain", "chunk_pos", "vec",
                        F.pmod(F.xxhash64("chunk_pos"), F.col("_nb")).alias("_cb"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nq") - 1)).alias("_qb")))
    qcols = ["question_id", "domain", "qvec"] + (["self_pos"] if exclude_self else [])
    qb = (queries.join(stat, "domain")
                 .select(*qcols,
                         F.pmod(F.xxhash64("question_id"), F.col("_nq")).alias("_qb"),
                         F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)).alias("_cb")))
    fn = _block_topk_fn(k, digits, metric, exclude_self)
    return (cb.groupBy("domain", "_cb", "_qb")
              .cogroup(qb.groupBy("domain", "_cb", "_qb"))
              .applyInPandas(fn, _TOPK_SCHEMA))


def final_topk(cands: DataFrame, k: int = 10) -> DataFrame:
    w = Window.partitionBy("question_id", "domain").orderBy(F.col("distance").asc(), F.col("chunk_pos").asc())
    return (cands.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
                 .select("question_id", "domain", (F.col("_rn") - 1).cast("int").alias("rank"),
                         "chunk_pos", "distance"))


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, digits: int | None = 6,
                metric: str = "l2", exclude_self: bool = False, block_rows: int = 20_000,
                query_block_rows: int = 20_000, broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """(question_id, domain, rank, chunk_pos, distance), ascending distance, ties by
    corpus position, ``rank`` 0-based."""
    return final_topk(vector_candidates(queries, corpus, k, digits, metric, exclude_self,
                                        block_rows, query_block_rows, broadcast_values), k)


def cell_centers(corpus: DataFrame, cells: int, sample_rows: int = 20_000, seed: int = 7) -> np.ndarray:
    """k-means centres of a bounded sample of the vectors (least hashes of their positions)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    rows = corpus.orderBy(F.xxhash64("domain", "chunk_pos")).limit(sample_rows)
    fit = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="v").fit(rows.select(array_to_vector("vec").alias("v")))
    return np.array(fit.clusterCenters())


def nearest_cells(df: DataFrame, vec_col: str, centers: np.ndarray, probes: int, out: str) -> DataFrame:
    """``out``: the numbers of the ``probes`` nearest centres (bounded: cells x dims)."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(np.float64)
        step, own = max(1, SLAB // len(centers)), (centers * centers).sum(axis=1)[None, :]
        got = [np.argsort(own - 2.0 * (x[i:i + step] @ centers.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
               for i in range(0, len(x), step)]
        return pd.Series(list(np.concatenate(got)))
    return df.withColumn(out, near(vec_col))


def vector_topk_cells(queries: DataFrame, corpus: DataFrame, k: int = 10, digits: int | None = 6, cells: int = 32,
                      probes: int = 4, metric: str = "l2", exclude_self: bool = False, block_rows: int = 20_000,
                      centers: np.ndarray | None = None) -> DataFrame:
    """Approximate top k. Vectors lie in the cell of their nearest k-means centre; a
    question is compared with the vectors of its own domain in its ``probes`` nearest cells
    only, by the exact block kernel of E3 (distances are exact, recall < 1 by design). A
    large cell is cut into blocks like a large domain."""
    centers = cell_centers(corpus, cells) if centers is None else centers
    probes = min(probes, len(centers))
    at = lambda c: F.concat_ws("\u0001", F.coalesce("domain", F.lit("")), F.isnull("domain").cast("string"), c)
    c = nearest_cells(corpus, "vec", centers, 1, "_cells").select(
        at(F.col("_cells")[0].cast("string")).alias("domain"), "chunk_pos", "vec")
    own = ["self_pos"] if exclude_self else []
    q = (nearest_cells(queries, "qvec", centers, probes, "_cells").withColumn("_cell", F.explode("_cells"))
         .select("question_id", at(F.col("_cell").cast("string")).alias("domain"), "qvec", *own))
    got = _block_candidates(q, c, k, digits, metric, exclude_self, block_rows, block_rows)
    parts = F.split("domain", "\u0001")
    return final_topk(got.withColumn("domain", F.when(parts[1] == "false", parts[0])), k)
