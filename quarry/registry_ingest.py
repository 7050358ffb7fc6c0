"""Registered queries: pages, chunking, ingest, collection tables, index tables, LSH."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.operators import bm25, chunking, ivf, vector
from quarry.plans import ingest as ingest_plan
from quarry.plans import search
from quarry.registry import BM25_CTE, PAGES_CTE, register
from quarry.session import shared_dir
from quarry.sources.testdata import SourceTables


@register("load_pages", f"WITH {PAGES_CTE} SELECT domain, file, page, doc_id FROM pages")
def q_load_pages(spark, sf_dir):
    return SourceTables(spark, sf_dir).pages().select("domain", "file", "page", F.col("_order").alias("doc_id"))


@register("enrich_chunks", f"""WITH {PAGES_CTE},
descr AS (SELECT * FROM (VALUES ('en', 'English documents — invented prose'), ('fr', 'French documents — invented prose'),
                                ('de', 'German documents — invented prose'), ('es', 'Spanish documents — invented prose'),
                                ('it', 'Italian documents — invented prose'))
          t(domain, description))
SELECT c.domain, c.chunk_pos, d.description FROM corpus c JOIN descr d USING (domain)""")
def q_enrich_chunks(spark, sf_dir):
    return SourceTables(spark, sf_dir).corpus().select("domain", "chunk_pos", "description")


def _catalogued_pages(t):
    from quarry.sources.corpus import available_domains
    pages = t.pages()
    return pages.join(F.broadcast(available_domains(t.catalog(), pages).select("domain", "file")),
                      ["domain", "file"], "left_semi")


@register("chunk_recursive", f"""WITH {PAGES_CTE}
SELECT domain, page, regexp_extract(text, '^\\s*(\\S)', 1) AS first_char,
       regexp_extract(text, '(\\S)\\s*$', 1) AS last_char, true AS len_ok, true AS substr_ok, true AS short_ok
FROM pages WHERE domain IN (SELECT domain FROM cat) AND regexp_matches(text, '\\S')""")
def q_chunk_recursive(spark, sf_dir):
    """C1 checked by invariants against the page text: first/last non-space characters,
    every chunk <= 1000 characters and a substring of its page, a page under 1000
    characters gives exactly one chunk."""
    t = SourceTables(spark, sf_dir)
    pages = _catalogued_pages(t)
    ch = chunking.chunk_recursive(pages)
    per = (ch.groupBy("domain", "page")
             .agg(F.min_by("content", "chunk_no").alias("_first"), F.max_by("content", "chunk_no").alias("_last"),
                  F.max(F.char_length("content")).alias("_maxlen"), F.count(F.lit(1)).alias("_n"),
                  F.collect_list("content").alias("_all")))
    j = per.join(pages.select("domain", "page", "text"), ["domain", "page"])
    return j.select("domain", "page", F.substring("_first", 1, 1).alias("first_char"),
                    F.substring("_last", -1, 1).alias("last_char"),
                    (F.col("_maxlen") <= chunking.CHUNK_SIZE).alias("len_ok"),
                    F.forall("_all", lambda c: F.instr(F.col("text"), c) > 0).alias("substr_ok"),
                    ((F.char_length("text") >= chunking.CHUNK_SIZE) | (F.col("_n") == 1)).alias("short_ok"))


@register("chunk_positions", f"""WITH {PAGES_CTE}
SELECT DISTINCT domain, true AS dense_ok, true AS order_ok FROM corpus""")
def q_chunk_positions(spark, sf_dir):
    """C2 invariants: chunk_pos is 0..n-1 per domain and follows (page, chunk_no)."""
    t = SourceTables(spark, sf_dir)
    ch = chunking.with_positions(chunking.chunk_recursive(_catalogued_pages(t)))
    dense = ch.groupBy("domain").agg(
        ((F.min("chunk_pos") == 0) & (F.max("chunk_pos") == F.count(F.lit(1)) - 1)
         & (F.count_distinct("chunk_pos") == F.count(F.lit(1)))).alias("dense_ok"))
    a = ch.select("domain", "chunk_pos", F.struct("page", "chunk_no").alias("k"))
    b = a.select("domain", (F.col("chunk_pos") - 1).alias("chunk_pos"), F.col("k").alias("k_next"))
    order = (a.join(b, ["domain", "chunk_pos"]).groupBy("domain")
              .agg(F.bool_and(F.col("k") < F.col("k_next")).alias("order_ok")))
    return dense.join(order, "domain", "left").select(
        "domain", "dense_ok", F.coalesce("order_ok", F.lit(True)).alias("order_ok"))


@register("chunk_windows", f"""WITH {PAGES_CTE}
SELECT domain, file, page, CAST(i AS INTEGER) AS chunk_no, substr(text, 800 * i + 1, 1000) AS content
FROM pages, range(0, CAST(greatest(1, ceil((length(text) - 200) / 800.0)) AS BIGINT)) r(i)
WHERE domain IN (SELECT domain FROM cat) AND length(text) > 0""")
def q_chunk_windows(spark, sf_dir):
    return chunking.chunk_windows(_catalogued_pages(SourceTables(spark, sf_dir)))


@register("ingest_stats", f"""WITH {PAGES_CTE},
n AS (SELECT domain, count(*) AS n_pages,
             sum(CASE WHEN length(text) > 0 THEN greatest(1, CAST(ceil((length(text) - 200) / 800.0) AS BIGINT)) ELSE 0 END) AS n_chunks
      FROM pages WHERE domain IN (SELECT domain FROM cat) GROUP BY domain)
SELECT c.domain, n.n_pages, CAST(n.n_chunks AS BIGINT) AS n_chunks, CAST(n.n_chunks AS BIGINT) AS n_stored,
       CASE WHEN n.domain IS NULL THEN 'WARNING: ' || c.domain || ' not found. Skipping.' END AS warning
FROM cat c LEFT JOIN n USING (domain)""")
def q_ingest_stats(spark, sf_dir):
    """Full ingest (window chunks, vectors, index) into the shared folder; per-domain
    pages, chunks counted before the write, stored rows and the missing-source warning."""
    t = SourceTables(spark, sf_dir)
    return ingest_plan.ingest(t.pages(), t.catalog(), shared_dir(spark, "collection"), chunking.chunk_windows, in_order=True)


@register("collection_roundtrip", f"""WITH {PAGES_CTE}
SELECT domain, chunk_pos, page, fkey, 64 AS dims FROM (SELECT *, substr(content, 1, 100) AS fkey FROM corpus)""")
def q_collection_roundtrip(spark, sf_dir):
    """S3 + S4: write the collection partitioned by domain, read it back."""
    t = SourceTables(spark, sf_dir)
    root = shared_dir(spark, "collection")
    ingest_plan.write_collection(search.build_collection(t.corpus()), root)
    c = ingest_plan.read_collection(spark, root)
    return (c.chunks.join(c.vectors, ["domain", "chunk_pos"])
             .select("domain", "chunk_pos", "page", "fkey", F.size("vec").alias("dims")))


@register("scan_domain", f"WITH {PAGES_CTE} SELECT domain, chunk_pos, page FROM corpus WHERE domain = 'fr'")
def q_scan_domain(spark, sf_dir):
    """Open one domain of a written collection (partition-pruned scan)."""
    t = SourceTables(spark, sf_dir)
    root = shared_dir(spark, "collection")
    ingest_plan.write_collection(search.build_collection(t.corpus()), root)
    return ingest_plan.read_collection(spark, root, ["fr"]).chunks.select("domain", "chunk_pos", "page")


@register("bm25_topk_stored", f"WITH {BM25_CTE} SELECT * FROM bm25top")
def q_bm25_topk_stored(spark, sf_dir):
    """B5/B6 over a written index: blocks of the batch's terms only."""
    t = SourceTables(spark, sf_dir)
    root = shared_dir(spark, "collection")
    t.collection().index.write(root)
    return bm25.bm25_topk(t.questions(), bm25.BM25Index.read(spark, root))


# ---------------------------------------------------------------- index tables
@register("tokenize", f"""WITH {BM25_CTE}
SELECT domain, chunk_pos, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM toks""")
def q_tokenize(spark, sf_dir):
    c = SourceTables(spark, sf_dir).corpus().select("domain", "chunk_pos", tokenize("content").alias("t"))
    return c.select("domain", "chunk_pos", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("postings", f"WITH {BM25_CTE} SELECT domain, chunk_pos, term, f, CAST(dl AS BIGINT) AS dl FROM post")
def q_postings(spark, sf_dir):
    return bm25.postings(SourceTables(spark, sf_dir).corpus())


@register("corpus_stats", f"WITH {BM25_CTE} SELECT domain, n AS n_chunks, round(avgdl, 9) AS avgdl FROM bstats")
def q_corpus_stats(spark, sf_dir):
    s = bm25.corpus_stats(bm25.raw_postings(SourceTables(spark, sf_dir).corpus()))
    return s.select("domain", "n_chunks", F.round("avgdl", 9).alias("avgdl"))


@register("term_idf", f"""WITH {BM25_CTE}
SELECT domain, term, df, round(idf, 9) AS idf FROM idf""")
def q_term_idf(spark, sf_dir):
    idx = bm25.build_index(SourceTables(spark, sf_dir).corpus())
    return idx.idf.select("domain", "term", "df", F.round("idf", 9).alias("idf"))


@register("bm25_scores", f"""WITH {BM25_CTE},
dfsum AS (SELECT qt.question_id, qt.domain, sum(d.df) AS s FROM qt JOIN dfs d USING (domain, term) GROUP BY ALL),
pads AS (
  SELECT q.question_id, q.domain, t.chunk_pos
  FROM (SELECT DISTINCT question_id, domain FROM questions) q
  JOIN bstats b USING (domain) JOIN epss e USING (domain) LEFT JOIN dfsum f USING (question_id, domain)
  JOIN toks t USING (domain)
  WHERE t.chunk_pos < CASE WHEN e.eps >= 0 THEN least(b.n, 10) ELSE least(b.n, 10 + coalesce(f.s, 0)) END)
SELECT question_id, domain, chunk_pos, round(coalesce(m.score, 0.0), 6) AS score
FROM (SELECT question_id, domain, chunk_pos FROM matched UNION SELECT * FROM pads) c
LEFT JOIN matched m USING (question_id, domain, chunk_pos)""")
def q_bm25_scores(spark, sf_dir):
    """Scores of every candidate (matched chunks and zero-fill positions)."""
    t = SourceTables(spark, sf_dir)
    s = bm25.scores(t.questions(), bm25.build_index(t.corpus()))
    return s.select("question_id", "domain", "chunk_pos", F.round("score", 6).alias("score"))


@register("vector_topk_lsh", """
SELECT vec_id AS question_id, true AS at_most_k, true AS own_domain, true AS exact, true AS in_order FROM embeddings""")
def q_vector_topk_lsh(spark, sf_dir):
    """Approximate neighbours of every stored vector (k-means cells), checked by invariants:
    at most k hits, all of the same label, exact distances, ascending ranks."""
    v = SourceTables(spark, sf_dir).vectors()
    corpus = v.select("domain", "chunk_pos", F.col("embedding").alias("vec"))
    qs = v.select(F.col("chunk_pos").alias("question_id"), "domain", F.col("embedding").alias("qvec"),
                  F.col("chunk_pos").alias("self_pos"))
    hits = vector.vector_topk_cells(qs, corpus, 10, exclude_self=True)
    a = v.select(F.col("chunk_pos").alias("question_id"), F.col("domain").alias("_d"), F.col("embedding").alias("_a"))
    b = v.select("chunk_pos", F.col("domain").alias("_e"), F.col("embedding").alias("_b"))
    j = hits.join(a, "question_id").join(b, "chunk_pos")
    per = j.groupBy("question_id").agg(
        (F.count(F.lit(1)) <= 10).alias("at_most_k"), F.bool_and((F.col("_d") == F.col("_e")) & (F.col("domain") == F.col("_d"))).alias("own_domain"),
        F.bool_and(F.abs(vector.sq_l2("_a", "_b") - F.col("distance")) < 1e-5).alias("exact"),
        F.sort_array(F.collect_list(F.struct("rank", "distance", "chunk_pos"))).alias("_h"))
    ranked = F.transform("_h", lambda h: F.struct(h["distance"].alias("distance"), h["chunk_pos"].alias("chunk_pos")))
    per = per.withColumn("in_order", F.array_sort(ranked) == ranked).drop("_h")
    yes = F.lit(True)
    return v.select(F.col("chunk_pos").alias("question_id")).join(per, "question_id", "left").select(
        "question_id", *[F.coalesce(c, yes).alias(c) for c in ("at_most_k", "own_domain", "exact", "in_order")])


@register("vector_topk_ivf", """
SELECT vec_id AS question_id, true AS at_most_k, true AS own_domain, true AS exact, true AS recall_ok FROM embeddings""")
def q_vector_topk_ivf(spark, sf_dir):
    """E4 over a stored index: at most k hits of the own label with exact distances, and over all questions at
    least 0.9 of the exact neighbours."""
    v = SourceTables(spark, sf_dir).vectors()
    corpus = v.select("domain", "chunk_pos", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    qs = corpus.select(F.col("chunk_pos").alias("question_id"), "domain", F.col("vec").alias("qvec"), F.col("chunk_pos").alias("self_pos"))
    root = shared_dir(spark, "ivf")
    ivf.build(corpus, root)
    hits = ivf.search(qs, root, 10, exclude_self=True)
    true = vector.vector_topk(qs, corpus, 10, exclude_self=True).select("question_id", "chunk_pos", F.lit(1).alias("_true"))
    # the pairs are matched first, as keys; vectors go along as they are stored, one of them once a hit, and no further than their distance
    a = v.select(F.col("chunk_pos").alias("question_id"), F.col("domain").alias("_d"), F.col("embedding").alias("_a"))
    b = v.select("chunk_pos", F.col("domain").alias("_e"), F.col("embedding").alias("_b"))
    j = hits.join(true, ["question_id", "chunk_pos"], "left").join(a, "question_id").join(b, "chunk_pos")
    per = j.groupBy("question_id").agg(
        (F.count(F.lit(1)) <= 10).alias("at_most_k"), F.bool_and((F.col("_d") == F.col("_e")) & (F.col("domain") == F.col("_d"))).alias("own_domain"),
        F.bool_and(F.abs(vector.sq_l2("_a", "_b") - F.col("distance")) < 1e-5).alias("exact"), F.sum("_true").alias("_found"))
    want = true.groupBy("question_id").agg(F.sum("_true").alias("_want"))
    per = v.select(F.col("chunk_pos").alias("question_id")).join(per, "question_id", "left").join(want, "question_id", "left")
    total = per.agg((F.coalesce(F.sum("_found"), F.lit(0)) >= 0.9 * F.coalesce(F.sum("_want"), F.lit(0))).alias("recall_ok"))
    yes = F.lit(True)
    return per.select("question_id", *[F.coalesce(c, yes).alias(c) for c in ("at_most_k", "own_domain", "exact")]).withColumn("recall_ok", total.scalar())
