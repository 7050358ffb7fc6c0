"""Page and chunk tables (S1, S2, P1) and question tables.

Page numbers and corpus positions are dense 0-based positions inside a domain,
computed by :mod:`quarry.functions.ranges` so that a domain holding a
third of all pages is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import ranges
from quarry.functions.broadcast import dim_broadcast
from quarry.functions.text import prefix_key

PAGES_SCHEMA = "domain string, file string, page long, text string"


def load_pages(docs: DataFrame, domain_col: str, file_col: str, order_col: str, text_col: str,
               meta_cols: tuple[str, ...] = ()) -> DataFrame:
    """A table of source rows becomes pages: ``page`` is the 0-based position of the row
    in its file, ordered by ``order_col``. The text moves once, into ranges of (domain, file, order), and is kept
    there (:func:`quarry.functions.ranges.ranged`): rows come in order and chunks can be cut and numbered in place. ``meta_cols`` become the page's open metadata
    (``meta``, a map from their names to their values as text)."""
    meta = [F.create_map(*[x for c in meta_cols for x in (F.lit(c), F.col(c).cast("string"))]).alias("meta")] if meta_cols else []
    base = docs.select(F.col(domain_col).alias("domain"), F.col(file_col).alias("file"),
                       F.col(order_col).alias("_order"), F.col(text_col).alias("text"), *meta)
    placed = ranges.ranged(base, ["domain", "file", "_order"])
    # files are catalog entries: at most ranges + files bases
    pos = ranges.positions(placed, ["domain", "file"], "page", small=True)
    return pos.select("domain", "file", "page", "_order", "text", *(["meta"] if meta_cols else []))


def available_domains(cat: DataFrame, pages: DataFrame) -> DataFrame:
    """Catalog rows whose source file has pages (left semi join)."""
    return cat.join(pages.select("domain", "file").distinct(), ["domain", "file"], "left_semi")


def missing_sources(cat: DataFrame, pages: DataFrame) -> DataFrame:
    """Catalog rows whose file is absent; ingest skips them with this report."""
    return (cat.join(pages.select("domain", "file").distinct(), ["domain", "file"], "left_anti")
               .select("ord", "domain", "file",
                       F.format_string("WARNING: %s not found. Skipping.", F.col("file")).alias("warning")))


def enrich(chunks: DataFrame, cat: DataFrame) -> DataFrame:
    """Attach the catalog ``description`` to every chunk of a catalogued domain
    (broadcast lookup; the catalog is one row per domain)."""
    return chunks.join(dim_broadcast(cat.select("domain", "description")), "domain", "inner")


def pages_as_chunks(pages: DataFrame, cat: DataFrame) -> DataFrame:
    """Corpus where each page is one chunk (chunk_no 0): the retrieval corpus used when
    pages are already passage-sized. ``chunk_pos`` = page position in the domain."""
    c = available_domains(cat, pages).select("domain", "file")
    return enrich(
        pages.join(dim_broadcast(c), ["domain", "file"], "left_semi")
             .select("domain", F.col("page").alias("chunk_pos"), "page",
                     F.lit(0).alias("chunk_no"), F.col("text").alias("content"),
                     prefix_key("text").alias("fkey")),
        cat)


def questions_for_domains(items: DataFrame, id_col: str, text_col: str, domains: list[str],
                          session_col: str | None = None) -> DataFrame:
    """Every question asked of each listed domain: one output row per (item, domain).
    ``domains`` is request configuration (a short literal list), applied with explode."""
    q = items.select(F.col(id_col).cast("long").alias("question_id"),
                     (F.col(session_col).cast("string") if session_col else F.lit(None).cast("string")).alias("session_id"),
                     F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain"),
                     F.col(text_col).alias("question"))
    return q
