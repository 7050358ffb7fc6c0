"""BM25 (Okapi) keyword search as index tables plus one join per question batch.

Index (built once per corpus, reusable, persistable):
  postings(domain, chunk_pos, term, f, dl, w) term frequency f, chunk length dl, BM25 weight w
  stats(domain, n_chunks, avgdl, eps)        one row per domain; eps = 0.25 * mean raw idf
  idf(domain, term, df, idf)                 floored idf (negative -> eps)

Scoring a batch of questions joins question terms (small, size-checked broadcast) to
the postings (streamed, never shuffled for the join), sums per (question, chunk), and
keeps the top k per question with a row_number filter that Spark plans as a partial
``WindowGroupLimit`` before the shuffle, so a question matching millions of chunks
ships at most k rows per map task.

Fixed values: k1 = 1.5, b = 0.75, epsilon = 0.25 (the Okapi defaults of the library the
original application calls).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.broadcast import dim_broadcast, fits
from quarry.functions.ranges import kept
from quarry.functions.text import tokenize
from quarry.operators import blocks

K1 = 1.5
B = 0.75
EPSILON = 0.25
PAD_BLOCK = 1 << 16


def replace_domains(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite exactly the partitions that ``df`` holds, whatever the session's default."""
    (df.write.mode("overwrite").options(**blocks.PARQUET).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


@dataclass
class BM25Index:
    postings: DataFrame        # domain, chunk_pos, term, f, dl
    stats: DataFrame           # domain, n_chunks, avgdl, eps
    idf: DataFrame             # domain, term, df, idf
    stored: blocks.Blocks | None = None   # postings in blocks, when the index was read from tables

    def persist(self, postings: bool = True) -> "BM25Index":
        """Cache the index tables; ``postings=False`` when they are a cheap filter over an
        already cached raw-postings table (the filter keeps its partitioning)."""
        return BM25Index(kept(self.postings) if postings else self.postings, self.stats.persist(), kept(self.idf))

    def write(self, path: str) -> None:
        """Per-domain replaceable tables: postings in blocks with bounds, dictionary, statistics."""
        blocks.write(self.postings, self.stats, self.idf, path, K1, B, replace_domains)
        replace_domains(self.stats, f"{path}/stats", "domain")

    @staticmethod
    def read(spark, path: str, domains: list[str] | None = None) -> "BM25Index":
        at = blocks.Blocks.read(spark, path, domains)
        stats = spark.read.parquet(f"{path}/stats")
        return BM25Index(at.postings(), stats.where(F.col("domain").isin(domains)) if domains else stats,
                         at.terms.select("domain", "term", "df", "idf"), at)


def tokens(df: DataFrame, text_col: str, out: str = "tokens") -> DataFrame:
    """B1: add the token array column."""
    return df.withColumn(out, tokenize(text_col))


def raw_postings(chunks: DataFrame, text_col: str = "content", partitions: int | None = None) -> DataFrame:
    """One pass over the text: (domain, chunk_pos, dl, term, f), with one row of null
    term for a chunk without tokens (so every chunk is represented).

    Chunks are shuffled once by (domain, chunk_pos); the explode and the per-chunk term
    count then run where the chunk lives, and every later aggregation keyed by a superset
    of (domain, chunk_pos) (lengths, hash vectors) reuses that partitioning.
    """
    base = chunks.select("domain", "chunk_pos", text_col)
    base = base.repartition(partitions, "domain", "chunk_pos") if partitions else base.repartition("domain", "chunk_pos")
    t = base.select("domain", "chunk_pos", tokenize(text_col).alias("_t"))
    return (t.select("domain", "chunk_pos", F.size("_t").cast("long").alias("dl"), F.explode_outer("_t").alias("term"))
             .groupBy("domain", "chunk_pos", "dl", "term").agg(F.count(F.lit(1)).cast("long").alias("f")))


def postings_in_place(counted: DataFrame) -> DataFrame:
    """The rows of :func:`raw_postings` from ``counted(domain, chunk_pos, dl, terms)`` (:func:`quarry.operators.vector.with_terms`, packed): only an
    explode, the text is not moved."""
    terms = F.when(F.size("terms.f") > 0, F.arrays_zip(F.split("terms.words", " ").alias("term"), F.col("terms.f").alias("f")))
    t = counted.select("domain", "chunk_pos", "dl", F.explode_outer(terms).alias("t"))
    return t.select("domain", "chunk_pos", "dl", F.col("t.term").alias("term"), F.col("t.f").cast("long").alias("f"))


def postings(chunks_or_raw: DataFrame, text_col: str = "content") -> DataFrame:
    """B2: (domain, chunk_pos, term, f, dl), from chunks or from :func:`raw_postings`."""
    raw = chunks_or_raw if "term" in chunks_or_raw.columns else raw_postings(chunks_or_raw, text_col)
    return raw.where(F.col("term").isNotNull()).select("domain", "chunk_pos", "term", "f", "dl")


def chunk_lengths(raw: DataFrame) -> DataFrame:
    """(domain, chunk_pos, dl) for every chunk (no shuffle after :func:`raw_postings`)."""
    return raw.groupBy("domain", "chunk_pos").agg(F.max("dl").alias("dl"))


def corpus_stats(raw: DataFrame) -> DataFrame:
    """N and avgdl per domain, counting chunks with no tokens too."""
    return (chunk_lengths(raw).groupBy("domain")
                              .agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.col("dl").cast("double")).alias("avgdl")))


def term_idf(post: DataFrame, stats: DataFrame, persist: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw idf ln(N-df+0.5) - ln(df+0.5); negatives replaced by the domain's eps.
    Returns (idf table, stats with eps). ``persist`` keeps the per-term table that both
    outputs derive from, so document frequencies are counted once."""
    df = post.groupBy("domain", "term").agg(F.count(F.lit(1)).alias("df"))
    raw = (df.join(dim_broadcast(stats.select("domain", "n_chunks")), "domain")
             .withColumn("raw", F.log(F.col("n_chunks") - F.col("df") + F.lit(0.5))
                         - F.log(F.col("df") + F.lit(0.5))))
    if persist:
        raw = kept(raw)
    eps = raw.groupBy("domain").agg((F.lit(EPSILON) * F.avg("raw")).alias("eps"))
    idf = (raw.join(dim_broadcast(eps), "domain")
              .select("domain", "term", F.col("df").cast("long").alias("df"),
                      F.when(F.col("raw") < 0, F.col("eps")).otherwise(F.col("raw")).alias("idf")))
    return idf, stats.join(eps, "domain", "left")


def stats_of_lengths(lengths: DataFrame) -> DataFrame:
    """B3 from one row per chunk (domain, dl)."""
    return lengths.groupBy("domain").agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.col("dl").cast("double")).alias("avgdl"))


def index_from_raw(raw: DataFrame, persist: bool = True, lengths: DataFrame | None = None) -> BM25Index:
    """``lengths``: one row per chunk (domain, dl), where the caller has them."""
    post = postings(raw)
    idf, stats = term_idf(post, corpus_stats(raw) if lengths is None else stats_of_lengths(lengths), persist=persist)
    return BM25Index(post, stats, idf)


def build_index(chunks: DataFrame, text_col: str = "content") -> BM25Index:
    return index_from_raw(raw_postings(chunks, text_col))


def question_terms(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """Question tokens with multiplicity ``qtf`` (a repeated token counts each time)."""
    return (questions.select("question_id", "domain", F.explode(tokenize(text_col)).alias("term"))
                     .groupBy("question_id", "domain", "term").agg(F.count(F.lit(1)).alias("qtf")))


def scores(questions: DataFrame, index: BM25Index, k: int = 10, text_col: str = "question",
           max_broadcast_rows: int = 2_000_000) -> DataFrame:
    """B5 plus the zero-fill candidates of B6: (question_id, domain, chunk_pos, score).

    Question terms are joined to the idf table (small result, broadcast), then to the
    postings. In-memory postings are partitioned by (domain, chunk_pos), so the
    per-(question, chunk) sum needs no shuffle; of stored postings only the blocks that can bring a
    chunk into the top k are read (:mod:`quarry.operators.blocks`), and their chunks alone are scored.
    ``question_id`` must be unique per domain.

    Candidates are the matched chunks plus the first ``pad`` chunks of the domain (score 0
    unless matched). ``pad = k`` when the domain's eps >= 0 (scores are never negative, so
    zero-score chunks enter the top k in corpus order and lie within the first k
    positions); otherwise ``pad = min(N, k + sum of df over the question's terms)``, an
    upper bound on matched chunks that can outrank zero. No cross join: pads are an
    explode of positions, joined by equality.
    """
    qt = question_terms(questions, text_col)
    small = fits(qt, max_broadcast_rows)
    if index.stored is not None and small:
        # Stored: only the blocks that can matter are read (a question's scores beyond its top k may be missing).
        qidf = blocks.with_terms(qt, index.stored, small).join(dim_broadcast(index.stats.select("domain", "avgdl", "eps")), "domain")
        contrib = blocks.contributions(qidf, index.stored, k, K1, B)
    else:
        # idf is unique per (domain, term): |qidf| <= |qt|, so the same check bounds it.
        qidf = (F.broadcast(qt) if small else qt).join(index.idf, ["domain", "term"])
        qidf = qidf.join(dim_broadcast(index.stats.select("domain", "avgdl")), "domain")
        contrib = (index.postings.join(F.broadcast(qidf) if small else qidf, ["domain", "term"])
                        .select("question_id", "domain", "chunk_pos", (F.col("qtf") * F.col("idf") * blocks.factor(
                            F.col("f"), F.col("dl"), F.col("avgdl"), K1, B)).alias("v")))
    st = dim_broadcast(index.stats)
    qs = questions.select("question_id", "domain").distinct()
    n_parts = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One row per domain: whether any domain floors idf with a negative eps decides
    # whether pads depend on the question's matches (rare) or are just the first k.
    if index.stats.where(F.col("eps") < 0).limit(1).count() == 0:
        pads = (qs.join(st, "domain")
                  .select("question_id", "domain",
                          F.explode(F.sequence(F.lit(0).cast("long"),
                                               F.least(F.col("n_chunks"), F.lit(k)).cast("long") - 1))
                           .alias("chunk_pos"),
                          F.lit(0.0).alias("v")))
    else:
        dfsum = qidf.groupBy("question_id", "domain").agg(F.sum("df").alias("_dfsum"))
        pads = (qs.join(st, "domain")
                  .join(dfsum, ["question_id", "domain"], "left")
                  .select("question_id", "domain",
                          F.when(F.coalesce(F.col("eps"), F.lit(0.0)) >= 0,
                                 F.least(F.col("n_chunks"), F.lit(k)))
                           .otherwise(F.least(F.col("n_chunks"), F.lit(k) + F.coalesce(F.col("_dfsum"), F.lit(0))))
                           .cast("long").alias("_pad"))
                  .where(F.col("_pad") > 0))
        # Two-level generation: block ids first (redistributed), then positions inside
        # each block, so a large pad is produced by many tasks.
        pb = PAD_BLOCK
        pads = (pads.select("question_id", "domain", "_pad",
                            F.explode(F.sequence(F.lit(0).cast("long"),
                                                 F.floor((F.col("_pad") - 1) / F.lit(pb)).cast("long"))).alias("_blk"))
                    .repartition(n_parts, "question_id", "domain", "_blk")
                    .select("question_id", "domain",
                            F.explode(F.sequence(F.col("_blk") * pb,
                                                 F.least(F.col("_pad"), (F.col("_blk") + 1) * pb) - 1))
                             .alias("chunk_pos"),
                            F.lit(0.0).alias("v")))
    # Pads are placed like the postings (hash of domain, chunk_pos), so the union keeps
    # that partitioning and the per-(question, chunk) sum runs without any shuffle; a
    # padded position that is also matched simply adds 0 to its real score.
    pads = pads.repartition(n_parts, "domain", "chunk_pos")
    return (contrib.unionByName(pads)
                   .groupBy("question_id", "domain", "chunk_pos").agg(F.sum("v").alias("score")))


def top_k(scored: DataFrame, k: int = 10, digits: int | None = 6) -> DataFrame:
    """Stable descending top k; ties keep corpus order. ``rank`` is 0-based.
    Scores are rounded to ``digits`` before ranking so that floating-point summation
    order (which varies with partitioning) cannot reorder near-equal scores."""
    s = scored.withColumn("score", F.round("score", digits)) if digits is not None else scored
    w = Window.partitionBy("question_id", "domain").orderBy(F.col("score").desc(), F.col("chunk_pos").asc())
    return (s.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
             .select("question_id", "domain", (F.col("_rn") - 1).cast("int").alias("rank"),
                     "chunk_pos", "score"))


def bm25_topk(questions: DataFrame, index: BM25Index, k: int = 10, digits: int | None = 6,
              text_col: str = "question") -> DataFrame:
    """Top k chunks per (question, domain) by BM25: (question_id, domain, rank, chunk_pos, score)."""
    return top_k(scores(questions, index, k, text_col), k, digits)
