"""Registered queries over the driver's test tables, and their DuckDB oracles.

Each query takes (spark, sf_dir) and returns a DataFrame built from the given tables;
each oracle is an independent SQL statement over the same parquet files (views named
after the tables). Column names match one to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import bm25, fusion, vector
from quarry.plans import search
from quarry.sources.testdata import SourceTables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------- SQL building blocks
WS_SQL = r"'\s+'"
CAT_SQL = "SELECT * FROM (VALUES ('en', 0), ('fr', 1), ('de', 2), ('es', 3), ('it', 4)) t(domain, ord)"
REQ_SQL = "SELECT * FROM (VALUES ('en'), ('fr'), ('de'), ('es'), ('it'), ('xx')) t(domain)"

PAGES_CTE = f"""
cat AS ({CAT_SQL}),
pages AS (
  SELECT lang AS domain, lang AS file, doc_id,
         CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS BIGINT) AS page, text
  FROM documents),
corpus AS (
  SELECT domain, CAST(page AS BIGINT) AS chunk_pos, page, text AS content
  FROM pages WHERE domain IN (SELECT domain FROM cat)),
questions AS (
  SELECT CAST(b.item_id AS BIGINT) AS question_id, r.domain, b.text AS question
  FROM benchmark b, ({REQ_SQL}) r)"""

BM25_CTE = PAGES_CTE + f""",
toks AS MATERIALIZED (
  SELECT domain, chunk_pos, list_filter(string_split_regex(lower(content), {WS_SQL}), lambda x: x <> '') AS t
  FROM corpus),
bstats AS (SELECT domain, count(*) AS n, avg(len(t)) AS avgdl FROM toks GROUP BY domain),
post AS MATERIALIZED (
  SELECT domain, chunk_pos, term, count(*) AS f, any_value(dl) AS dl
  FROM (SELECT domain, chunk_pos, len(t) AS dl, unnest(t) AS term FROM toks)
  GROUP BY domain, chunk_pos, term),
dfs AS (SELECT domain, term, count(*) AS df FROM post GROUP BY domain, term),
rawidf AS (
  SELECT d.domain, d.term, d.df, ln(s.n - d.df + 0.5) - ln(d.df + 0.5) AS raw
  FROM dfs d JOIN bstats s USING (domain)),
epss AS (SELECT domain, 0.25 * avg(raw) AS eps FROM rawidf GROUP BY domain),
idf AS MATERIALIZED (
  SELECT r.domain, r.term, r.df, CASE WHEN r.raw < 0 THEN e.eps ELSE r.raw END AS idf
  FROM rawidf r JOIN epss e USING (domain)),
qt AS (
  SELECT question_id, domain, term, count(*) AS qtf
  FROM (SELECT question_id, domain,
               unnest(list_filter(string_split_regex(lower(question), {WS_SQL}), lambda x: x <> '')) AS term
        FROM questions)
  GROUP BY question_id, domain, term),
matched AS (
  SELECT qt.question_id, qt.domain, p.chunk_pos,
         sum(qt.qtf * i.idf * p.f * 2.5 / (p.f + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl))) AS score
  FROM qt JOIN idf i USING (domain, term) JOIN post p USING (domain, term) JOIN bstats s USING (domain)
  GROUP BY qt.question_id, qt.domain, p.chunk_pos),
allscores AS (
  SELECT q.question_id, q.domain, t.chunk_pos, round(coalesce(m.score, 0.0), 6) AS score
  FROM (SELECT DISTINCT question_id, domain FROM questions) q
  JOIN toks t USING (domain)
  LEFT JOIN matched m USING (question_id, domain, chunk_pos)),
bm25top AS (
  SELECT question_id, domain, CAST(rn - 1 AS INTEGER) AS rank, chunk_pos, score FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, domain ORDER BY score DESC, chunk_pos) AS rn
    FROM allscores) WHERE rn <= 10)"""


# ---------------------------------------------------------------- BM25
@register("bm25_topk", f"WITH {BM25_CTE} SELECT * FROM bm25top")
def q_bm25_topk(spark, sf_dir):
    t = SourceTables(spark, sf_dir)
    return bm25.bm25_topk(t.questions(), t.collection().index)


# ---------------------------------------------------------------- vectors
def _hash_vec_cte(name: str, src: str, keys: str, text: str) -> str:
    """DuckDB form of the signed md5 feature hashing into 64 dims, L2-normalised."""
    k = [c.strip() for c in keys.split(",")]
    on = " AND ".join(f"s.{c} = b.{c}" for c in k)
    on2 = " AND ".join(f"n.{c} = b.{c}" for c in k)
    bk = ", ".join(f"b.{c}" for c in k)
    return f"""
{name}_tok AS (
  SELECT {keys}, unnest(list_filter(string_split_regex(lower({text}), {WS_SQL}), lambda x: x <> '')) AS tok
  FROM {src}),
{name}_sum AS (
  SELECT {keys}, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 64 AS bk,
         CAST(sum(CASE WHEN CAST(('0x' || substr(md5(tok), 9, 1)) AS INTEGER) < 8 THEN 1 ELSE -1 END) AS DOUBLE) AS v
  FROM {name}_tok GROUP BY ALL),
{name}_nrm AS (SELECT {keys}, sqrt(sum(v * v)) AS nrm FROM {name}_sum GROUP BY ALL),
{name} AS (
  SELECT {bk}, list(CASE WHEN n.nrm > 0 THEN coalesce(s.v, 0.0) / n.nrm ELSE 0.0 END ORDER BY r.i) AS vec
  FROM (SELECT DISTINCT {keys} FROM {src}) b CROSS JOIN range(64) r(i)
  LEFT JOIN {name}_sum s ON {on} AND s.bk = r.i
  LEFT JOIN {name}_nrm n ON {on2}
  GROUP BY {bk})"""


SQ_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

VEC_CTE = (BM25_CTE + ","
           + _hash_vec_cte("cvec", "corpus", "domain, chunk_pos", "content") + ","
           + _hash_vec_cte("qvec", "questions", "question_id, domain", "question") + f""",
vdist AS (
  SELECT q.question_id, q.domain, c.chunk_pos, round({SQ_L2.format(a='q.vec', b='c.vec')}, 6) AS distance
  FROM qvec q JOIN cvec c USING (domain)),
vtop AS (
  SELECT question_id, domain, CAST(rn - 1 AS INTEGER) AS rank, chunk_pos, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, domain ORDER BY distance, chunk_pos) AS rn
    FROM vdist) WHERE rn <= 10)""")

FUSION_CTE = VEC_CTE + """,
arms AS (
  SELECT question_id, domain, chunk_pos, rank, distance, 0 AS arm FROM vtop
  UNION ALL
  SELECT question_id, domain, chunk_pos, rank, CAST(NULL AS DOUBLE), 1 FROM bm25top),
contrib AS (
  SELECT a.question_id, a.domain, a.chunk_pos, a.rank, a.arm, a.distance, substr(c.content, 1, 100) AS fkey,
         CAST(a.arm AS BIGINT) * 1000000000 + a.rank AS ord, 1.0 / (a.rank + 60) AS rrf
  FROM arms a JOIN corpus c USING (domain, chunk_pos)),
fused AS (
  SELECT question_id, domain, fkey, round(sum(rrf), 9) AS score, min(ord) AS ord,
         arg_min(chunk_pos, ord) AS chunk_pos, coalesce(min(distance), 1.0) AS distance
  FROM contrib GROUP BY question_id, domain, fkey),
fusedrank AS (
  SELECT question_id, domain, CAST(rn - 1 AS INTEGER) AS rank, chunk_pos, score, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id, domain ORDER BY score DESC, ord) AS rn FROM fused)),
hybrid AS (
  SELECT f.question_id, f.domain, f.rank, f.chunk_pos, c.page, c.content, f.score, f.distance
  FROM fusedrank f JOIN corpus c USING (domain, chunk_pos) WHERE f.rank < 5)"""


@register("hash_embed", "WITH " + PAGES_CTE + "," + _hash_vec_cte("cvec", "corpus", "domain, chunk_pos", "content")
          + """
SELECT domain, chunk_pos, CAST(i - 1 AS INTEGER) AS dim, round(vec[i], 9) AS value
FROM cvec, range(1, 65) r(i) WHERE vec[i] <> 0""")
def q_hash_embed(spark, sf_dir):
    from pyspark.sql import functions as F
    t = SourceTables(spark, sf_dir)
    v = vector.hash_embed(t.corpus(), ["domain", "chunk_pos"], "content")
    return (v.select("domain", "chunk_pos", F.posexplode("embedding").alias("dim", "value"))
             .where(F.col("value") != 0)
             .select("domain", "chunk_pos", F.col("dim").cast("int").alias("dim"),
                     F.round("value", 9).alias("value")))


@register("vector_distance", f"""
SELECT a.vec_id, b.vec_id AS next_id,
       round({SQ_L2.format(a='CAST(a.embedding AS DOUBLE[])', b='CAST(b.embedding AS DOUBLE[])')}, 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_vector_distance(spark, sf_dir):
    from pyspark.sql import functions as F
    e = SourceTables(spark, sf_dir).table("embeddings")
    a, b = e.alias("a"), e.alias("b")
    return (a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
             .select(F.col("a.vec_id").alias("vec_id"), F.col("b.vec_id").alias("next_id"),
                     F.round(vector.sq_l2(F.col("a.embedding"), F.col("b.embedding")), 6).alias("distance")))


@register("vector_topk", f"""
SELECT question_id, domain, CAST(rn - 1 AS INTEGER) AS rank, chunk_pos, distance FROM (
  SELECT a.vec_id AS question_id, CAST(a.label AS VARCHAR) AS domain, b.vec_id AS chunk_pos,
         round({SQ_L2.format(a='CAST(a.embedding AS DOUBLE[])', b='CAST(b.embedding AS DOUBLE[])')}, 6) AS distance,
         row_number() OVER (PARTITION BY a.vec_id, a.label
                            ORDER BY round({SQ_L2.format(a='CAST(a.embedding AS DOUBLE[])', b='CAST(b.embedding AS DOUBLE[])')}, 6), b.vec_id) AS rn
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
WHERE rn <= 10""")
def q_vector_topk(spark, sf_dir):
    """Every stored vector as a query against the others of its label (self excluded)."""
    from pyspark.sql import functions as F
    v = SourceTables(spark, sf_dir).vectors()
    corpus = v.select("domain", "chunk_pos", F.col("embedding").alias("vec"))
    qs = v.select(F.col("chunk_pos").alias("question_id"), "domain", F.col("embedding").alias("qvec"),
                  F.col("chunk_pos").alias("self_pos"))
    return vector.vector_topk(qs, corpus, 10, exclude_self=True)


@register("doc_vector_topk", f"WITH {VEC_CTE} SELECT * FROM vtop")
def q_doc_vector_topk(spark, sf_dir):
    t = SourceTables(spark, sf_dir)
    return search.vector_arm(t.questions(), t.collection())


# ---------------------------------------------------------------- fusion and hybrid search
@register("fusion_key", "WITH " + PAGES_CTE + " SELECT domain, chunk_pos, substr(content, 1, 100) AS fkey FROM corpus")
def q_fusion_key(spark, sf_dir):
    from quarry.functions.text import prefix_key
    return SourceTables(spark, sf_dir).corpus().select("domain", "chunk_pos", prefix_key("content").alias("fkey"))


@register("rrf_scores", f"WITH {FUSION_CTE} SELECT question_id, domain, arm, rank, chunk_pos, round(rrf, 12) AS rrf FROM contrib")
def q_rrf_scores(spark, sf_dir):
    from pyspark.sql import functions as F
    t = SourceTables(spark, sf_dir)
    coll, q = t.collection(), t.questions()
    keys = coll.chunks.select("domain", "chunk_pos", F.substring("content", 1, 100).alias("fkey"))
    c = fusion.rrf_contributions(search.vector_arm(q, coll), search.bm25_arm(q, coll), keys)
    return c.select("question_id", "domain", "arm", "rank", "chunk_pos", F.round("rrf", 12).alias("rrf"))


@register("rrf_fuse", f"WITH {FUSION_CTE} SELECT * FROM fusedrank")
def q_rrf_fuse(spark, sf_dir):
    """All fused rows (no cut), exercising same-key accumulation within and across arms."""
    t = SourceTables(spark, sf_dir)
    coll, q = t.collection(), t.questions()
    return search.fuse(q, coll, search.vector_arm(q, coll), search.bm25_arm(q, coll), n=20)


@register("hybrid_search", f"WITH {FUSION_CTE} SELECT * FROM hybrid")
def q_hybrid_search(spark, sf_dir):
    t = SourceTables(spark, sf_dir)
    return search.hybrid_search(t.questions(), t.collection())


RETRIEVE_CTE = FUSION_CTE + """,
avail AS (SELECT '[' || string_agg('''' || domain || '''', ', ' ORDER BY ord) || ']' AS a FROM cat),
perq AS (
  SELECT question_id, domain, count(*) AS n_chunks,
         string_agg(CAST(chunk_pos AS VARCHAR), ',' ORDER BY rank) AS chunk_list,
         min(distance) FILTER (WHERE rank = 0) AS top_distance
  FROM hybrid GROUP BY question_id, domain),
retrieved AS (
  SELECT q.question_id, q.domain,
    CASE WHEN q.domain NOT IN (SELECT domain FROM cat) THEN false
         WHEN p.top_distance IS NULL THEN false
         ELSE p.top_distance <= 1.3 END AS confident,
    CASE WHEN q.domain NOT IN (SELECT domain FROM cat)
           THEN 'Unknown domain ''' || q.domain || '''. Available: ' || (SELECT a FROM avail)
         WHEN p.top_distance IS NULL THEN 'No results found.'
         WHEN p.top_distance > 1.3 THEN printf('Top result distance %.3f exceeds threshold 1.3.', round(p.top_distance, 3))
         ELSE NULL END AS reason,
    CASE WHEN q.domain IN (SELECT domain FROM cat) THEN coalesce(p.n_chunks, 0) ELSE 0 END AS n_chunks,
    CASE WHEN q.domain IN (SELECT domain FROM cat) THEN coalesce(p.chunk_list, '') ELSE '' END AS chunk_list,
    CASE WHEN q.domain IN (SELECT domain FROM cat) THEN p.top_distance END AS top_distance
  FROM questions q LEFT JOIN perq p USING (question_id, domain))"""


@register("retrieve", f"WITH {RETRIEVE_CTE} SELECT * FROM retrieved")
def q_retrieve(spark, sf_dir):
    from pyspark.sql import functions as F
    t = SourceTables(spark, sf_dir)
    r = search.retrieve(t.questions(), t.collection(), t.catalog())
    return r.select("question_id", "domain", "confident", "reason",
                    F.size("chunks").cast("long").alias("n_chunks"),
                    F.array_join(F.transform("chunks", lambda c: c["chunk_pos"].cast("string")), ",").alias("chunk_list"),
                    "top_distance")


@register("retrieve_metadata", f"""WITH {RETRIEVE_CTE}
SELECT h.question_id, h.domain, CAST(h.rank AS INTEGER) AS rank, h.chunk_pos, coalesce(d.source, 'unknown') AS source,
       coalesce(CAST(d.n_chars AS VARCHAR), 'unknown') AS n_chars, 'none' AS license
FROM hybrid h JOIN pages p ON p.domain = h.domain AND p.page = h.chunk_pos JOIN documents d ON d.doc_id = p.doc_id""")
def q_retrieve_metadata(spark, sf_dir):
    """Open page metadata on every retrieved chunk, with a default for a key that no page has."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    from quarry.operators.answers import meta_text
    from quarry.sources.corpus import load_pages
    t = SourceTables(spark, sf_dir)
    pages = load_pages(t.table("documents"), "lang", "lang", "doc_id", "text", ("source", "n_chars"))
    r = search.retrieve(t.questions(), replace(t.collection(), metadata=pages.select("domain", "page", "meta")), t.catalog())
    hits = r.select("question_id", "domain", F.explode("chunks").alias("c"))
    return hits.select("question_id", "domain", F.col("c.rank").alias("rank"), F.col("c.chunk_pos").alias("chunk_pos"),
                       meta_text("c.meta", "source").alias("source"), meta_text("c.meta", "n_chars").alias("n_chars"),
                       meta_text("c.meta", "license", "none").alias("license"))


# A small linear encoder: counts of these letters, times the matrix ((5 i + 3 j) % 7) - 3, over the text's length + 1.
PROJECTED_LETTERS = "etaoinshr"
PROJECTED_DIM = 4


def _letter_model():
    """Encoder for :func:`quarry.operators.vector.model_embed`: made once per Python worker."""
    import numpy as np
    matrix = (5 * np.arange(len(PROJECTED_LETTERS))[:, None] + 3 * np.arange(PROJECTED_DIM)) % 7 - 3

    def model(texts):
        counts = np.array([[x.count(c) for c in PROJECTED_LETTERS] for x in texts], np.int64).reshape(len(texts), -1)
        return (counts @ matrix) / (np.array([len(x) for x in texts], np.int64)[:, None] + 1)
    return model


_PROJECTED_SQL = ", ".join("round((" + " + ".join(
    f"({(5 * i + 3 * j) % 7 - 3}) * (length(content) - length(replace(content, '{c}', '')))" for i, c in enumerate(PROJECTED_LETTERS))
    + f")::DOUBLE / (length(content) + 1), 9) AS v{j}" for j in range(PROJECTED_DIM))


@register("model_embed", f"WITH {PAGES_CTE} SELECT domain, chunk_pos, {_PROJECTED_SQL} FROM corpus WHERE content IS NOT NULL")
def q_model_embed(spark, sf_dir):
    """Every chunk through a user-supplied encoder."""
    from pyspark.sql import functions as F
    corpus = SourceTables(spark, sf_dir).corpus().where("content is not null")
    v = vector.model_embed(corpus, "content", _letter_model, PROJECTED_DIM)
    return v.select("domain", "chunk_pos", *[F.round(F.get("embedding", j), 9).alias(f"v{j}") for j in range(PROJECTED_DIM)])


# The remaining groups register themselves on import.
from quarry import registry_conv  # noqa: E402,F401
from quarry import registry_ingest  # noqa: E402,F401
from quarry import registry_stream  # noqa: E402,F401
