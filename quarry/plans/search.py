"""Hybrid search and retrieval over a collection.

A *collection* is the chunk table plus its vectors and BM25 index; build it once
(:func:`build_collection`, or read what :mod:`quarry.plans.ingest` wrote) and answer any
number of question batches against it. A question batch is a table
(question_id, domain, question); every step is a join, aggregation or window over it.

Broadcast policy: the question batch is checked once (``fits``); tables derived from it
whose size is bounded by it (question terms, hits: <= 2k per question, fused hits:
<= n per question) are broadcast on that proof, so the corpus side is only streamed,
never shuffled for these joins. Beyond the limit every join falls back to the
optimizer's shuffle joins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.broadcast import DEFAULT_MAX_ROWS, dim_broadcast, fits, sized_broadcast
from quarry.functions.ranges import kept
from quarry.functions.text import prefix_key, py_list_literal
from quarry.operators import bm25, fusion, vector

# Default confidence threshold on the top hit's distance.
CONFIDENCE_THRESHOLD = 1.3
NO_RESULTS = "No results found."


@dataclass
class Collection:
    chunks: DataFrame          # domain, chunk_pos, page, chunk_no, content, description
    vectors: DataFrame         # domain, chunk_pos, vec
    index: bm25.BM25Index

    raw_cached: bool = False   # postings are an explode of cached term counts
    vectors_cached: bool = False   # vectors are a column of them
    cached: tuple = ()         # what building it keeps (released by ``release``)
    metadata: DataFrame | None = None  # domain, page, meta map<string,string>: open page metadata, one row a page

    def release(self) -> None:
        """Free what :func:`build_collection` and ``persist`` keep (recomputable)."""
        for df in (*self.cached, self.chunks, self.vectors, self.index.postings, self.index.stats, self.index.idf):
            df.unpersist()

    def persist(self) -> "Collection":
        return replace(self, chunks=kept(self.chunks), vectors=self.vectors if self.vectors_cached else kept(self.vectors),
                       index=self.index.persist(postings=not self.raw_cached))


def build_collection(chunks: DataFrame, dim: int = vector.DIM, embed=None, persist: bool = True) -> Collection:
    """Vectors (built-in hash encoder unless ``embed(df, key_cols, text_col)`` is given)
    and the BM25 index for a chunk table, from one pass over the text: terms are counted and embedded where the chunks
    lie (:func:`quarry.operators.vector.with_terms`), and a row a chunk with its term counts is shuffled by
    (domain, chunk_pos), so that sums over chunks need no exchange of postings.
    ``persist`` keeps these rows for the consumers (recomputable from lineage if an executor is lost)."""
    counted = vector.with_terms(chunks.select("domain", "chunk_pos", "content"), "content", dim, packed=True).drop("content")
    counted = counted.repartition("domain", "chunk_pos")
    if persist:
        counted = kept(counted)
    vecs = counted if embed is None else embed(chunks, ["domain", "chunk_pos"], "content")
    index = bm25.index_from_raw(bm25.postings_in_place(counted), lengths=counted.select("domain", "dl"))
    return Collection(chunks, vecs.select("domain", "chunk_pos", "vec"), index,
                      raw_cached=persist, cached=(counted,) if persist else (), vectors_cached=persist and embed is None)


def question_vectors(questions: DataFrame, dim: int = vector.DIM, embed=None) -> DataFrame:
    """Questions embedded with the same encoder as the chunks (hash encoder by default)."""
    emb = embed or (lambda df, keys, text: vector.hash_embed(df, keys, text, dim, out="qvec"))
    v = emb(questions, ["question_id", "domain"], "question")
    if "qvec" not in v.columns:
        v = v.withColumnRenamed("vec", "qvec")
    return v.select("question_id", "domain", "qvec")


def vector_arm(questions: DataFrame, coll: Collection, k: int = 10, embed=None,
               metric: str = "l2") -> DataFrame:
    return vector.vector_topk(question_vectors(questions, embed=embed), coll.vectors, k, metric=metric)


def bm25_arm(questions: DataFrame, coll: Collection, k: int = 10, min_score: float | None = None) -> DataFrame:
    """``min_score``: hits must score more (0.0 drops the zero-score fill); the default keeps all."""
    hits = bm25.bm25_topk(questions, coll.index, k)
    return hits if min_score is None else hits.where(F.col("score") > min_score)


def fusion_keys(chunks: DataFrame, key: str = "prefix") -> DataFrame:
    """(domain, chunk_pos, fkey): the content prefix (a stored ``fkey`` column when the
    collection has one), or with ``key="chunk_id"`` the chunk itself."""
    if key == "chunk_id":
        return chunks.select("domain", "chunk_pos", F.col("chunk_pos").cast("string").alias("fkey"))
    fk = F.col("fkey") if "fkey" in chunks.columns else prefix_key("content", fusion.KEY_CHARS)
    return chunks.select("domain", "chunk_pos", fk.alias("fkey"))


def fuse(questions: DataFrame, coll: Collection, vec_hits: DataFrame, bm_hits: DataFrame,
         n: int = fusion.N_RESULTS, small: bool = True, rank_base: int = 0, key: str = "prefix") -> DataFrame:
    """Each arm's hits are consumed once: the stacked arms (<= 2k rows per question,
    broadcast when the batch is small) are joined to the fusion keys of the collection."""
    contrib = fusion.rrf_contributions(vec_hits, bm_hits, fusion_keys(coll.chunks, key), rank_base=rank_base,
                                       broadcast_arms=small)
    return fusion.rrf_fuse(contrib, n)


def hybrid_search(questions: DataFrame, coll: Collection, n: int = fusion.N_RESULTS, k: int = 10,
                  embed=None, max_broadcast_rows: int = DEFAULT_MAX_ROWS, metric: str = "l2", rank_base: int = 0,
                  key: str = "prefix", min_score: float | None = None) -> DataFrame:
    """(question_id, domain, rank, chunk_pos, page, content, score, distance).
    Questions whose domain has no chunks yield no rows. ``max_broadcast_rows`` bounds the
    stacked hits (2k rows a question), which are what is broadcast."""
    small = fits(questions, max_broadcast_rows // max(1, 2 * k))
    vec_hits = vector_arm(questions, coll, k, embed, metric)
    bm_hits = bm25_arm(questions, coll, k, min_score)
    fused = fuse(questions, coll, vec_hits, bm_hits, n, small, rank_base, key)
    payload = coll.chunks.select("domain", "chunk_pos", "page", "content")
    hits = (fused.join(payload, ["domain", "chunk_pos"]) if not small
            else payload.join(F.broadcast(fused), ["domain", "chunk_pos"])).select(
        "question_id", "domain", "rank", "chunk_pos", "page", "content", "score", "distance")
    return hits if coll.metadata is None else with_metadata(hits, coll.metadata)


def with_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Attach the open metadata of the hits' pages as ``meta``; a page without any has an empty map.
    Pages are many and their maps wide, so only those of hits are kept before the join: pages hold their
    metadata once, not with every chunk."""
    asked = sized_broadcast(hits.select("domain", "page").distinct())
    own = metadata.select("domain", "page", "meta").join(asked, ["domain", "page"], "left_semi")
    none = F.create_map().cast("map<string,string>")
    return hits.join(own, ["domain", "page"], "left").withColumn("meta", F.coalesce("meta", none)).select(*hits.columns, "meta")


def validate(requests: DataFrame, cat: DataFrame) -> DataFrame:
    """Requests with ``valid`` and, for invalid ones, the reason
    ``Unknown domain '<d>'. Available: [...]`` (catalog order)."""
    # A scalar subquery over the catalog (one value), evaluated once per query.
    avail = cat.agg(
        py_list_literal(F.transform(F.sort_array(F.collect_list(F.struct("ord", "domain"))),
                                    lambda s: s["domain"])).alias("_avail")).scalar()
    known = dim_broadcast(cat.select("domain", F.lit(True).alias("_known")))
    r = requests.join(known, "domain", "left")
    valid = F.coalesce(F.col("_known"), F.lit(False))
    return (r.withColumn("valid", valid)
             .withColumn("reason", F.when(~valid, F.format_string("Unknown domain '%s'. Available: %s",
                                                                   F.col("domain"), avail)))
             .drop("_known"))


def gate(top_distance, threshold: float = CONFIDENCE_THRESHOLD):
    """P5: (confident, reason) for a top-hit distance column (null = no hits)."""
    over = top_distance > F.lit(threshold)
    confident = F.when(top_distance.isNull(), F.lit(False)).otherwise(~over)
    reason = (F.when(top_distance.isNull(), F.lit(NO_RESULTS))
               .when(over, F.format_string(f"Top result distance %.3f exceeds threshold {threshold}.",
                                           top_distance)))
    return confident, reason


HIT_FIELDS = ["rank", "chunk_pos", "page", "content", "score", "distance"]
HIT_TYPE = "rank:int,chunk_pos:bigint,page:bigint,content:string,score:double,distance:double"


def retrieve(requests: DataFrame, coll: Collection, cat: DataFrame,
             threshold: float = CONFIDENCE_THRESHOLD, n: int = fusion.N_RESULTS,
             embed=None, hits: DataFrame | None = None, **search_options) -> DataFrame:
    """R2: one row per request (question_id, domain, ...): confident, reason, chunks.

    Unknown domain -> not confident, catalog reason, no chunks (no search is run for it).
    No hits -> not confident, 'No results found.'. Top (fused first) hit distance
    strictly above ``threshold`` -> not confident, chunks still returned. Else confident.
    ``search_options`` (k, metric, rank_base, key, min_score) go to :func:`hybrid_search`.
    Chunks carry ``meta`` if the collection has metadata.
    """
    v = validate(requests, cat)
    valid = v.where("valid").select("question_id", "domain", "question")
    if hits is None:
        hits = hybrid_search(valid, coll, n, embed=embed, **search_options)
    meta = "meta" in hits.columns
    # ranks are unique; maps have no order
    by_rank = lambda a, b: a["rank"] - b["rank"]
    per_q = (hits.groupBy("question_id", "domain")
                 .agg(F.array_sort(F.collect_list(F.struct(*HIT_FIELDS, *(["meta"] if meta else []))), by_rank).alias("chunks"),
                      F.min_by("distance", "rank").alias("top_distance")))
    out = v.join(per_q, ["question_id", "domain"], "left")
    conf, reason = gate(F.col("top_distance"), threshold)
    return out.select(
        *[c for c in requests.columns],
        F.when(F.col("valid"), conf).otherwise(F.lit(False)).alias("confident"),
        F.when(F.col("valid"), reason).otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("valid") & F.col("chunks").isNotNull(), F.col("chunks"))
         .otherwise(F.array().cast(f"array<struct<{HIT_TYPE}{',meta:map<string,string>' if meta else ''}>>")).alias("chunks"),
        "top_distance")
