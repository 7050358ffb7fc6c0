"""Answer preparation.

All of it is column expressions over the retrieval table (one row per request with at
most ``n`` chunks), so nothing here shuffles beyond the joins the caller makes.
The model call is a user-supplied pandas UDF (Arrow batches) over the prompt column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.broadcast import dim_broadcast

# Texts of the original application.
REFUSAL = "I don't have enough information in this document to answer that confidently."
SYSTEM_TEMPLATE = (
    "You are a helpful assistant that answers questions based strictly on the provided document context.\n"
    "\n"
    "Document: {domain_context}\n"
    "\n"
    "Rules:\n"
    "- Answer only based on the context provided below\n"
    "- If the context does not contain enough information, say so clearly\n"
    "- Always mention which page your answer comes from\n"
    "- Be concise and precise\n"
    "- Do not make up information\n"
    "\n"
    "Context:\n"
    "{context}"
)
UNKNOWN_PAGE = "unknown"
MESSAGE = "struct<role:string,content:string>"


def page_text(page) -> Column:
    """Page number as text, 'unknown' when missing."""
    page = F.col(page) if isinstance(page, str) else page
    return F.coalesce(page.cast("string"), F.lit(UNKNOWN_PAGE))


def meta_text(meta, key: str, default: str = UNKNOWN_PAGE) -> Column:
    """P8 on open metadata: the value of ``key`` in a map, ``default`` when the map, the key or the value is missing."""
    meta = F.col(meta) if isinstance(meta, str) else meta
    return F.coalesce(F.try_element_at(meta, F.lit(key)), F.lit(default))


def format_context(chunks, meta_keys: tuple[str, ...] = ()) -> Column:
    """``[Source i | Page p]\\n<content>`` for each chunk in rank order (i from 1),
    joined by a blank line. ``meta_keys`` of the chunks' open metadata follow the page (`` | key: value``)."""
    chunks = F.col(chunks) if isinstance(chunks, str) else chunks
    ordered = F.array_sort(chunks, lambda a, b: (a["rank"] - b["rank"]).cast("int"))
    parts = F.transform(ordered, lambda c, i: F.format_string(
        f"[Source %d | Page %s{' | %s: %s' * len(meta_keys)}]\n%s", i + 1, page_text(c["page"]),
        *[x for k in meta_keys for x in (F.lit(k), meta_text(c["meta"], k))], c["content"]))
    return F.array_join(parts, "\n\n")


def cited_sources(chunks, confident) -> Column:
    """A4: distinct cited pages in ascending order (missing pages last); none when the
    answer is a refusal."""
    chunks = F.col(chunks) if isinstance(chunks, str) else chunks
    confident = F.col(confident) if isinstance(confident, str) else confident
    pages = F.array_sort(F.array_distinct(F.transform(chunks, lambda c: c["page"])))
    return F.when(confident, pages).otherwise(F.array().cast("array<bigint>"))


def system_prompt(domain_context, context) -> Column:
    """The system message: the template with the domain phrase and the context."""
    head, tail = SYSTEM_TEMPLATE.split("{domain_context}")
    mid, end = tail.split("{context}")
    return F.concat(F.lit(head), domain_context, F.lit(mid), context, F.lit(end))


def build_prompts(retrieved: DataFrame, cat: DataFrame, history: DataFrame | str | None = None,
                  keys: tuple[str, ...] = ("question_id", "domain")) -> DataFrame:
    """``prompt`` = [system, *history, user question] as array<struct<role, content>>
    for the confident requests. ``history`` (keys..., history array<struct<role,content>>)
    is optional, or the name of the column of ``retrieved`` that holds it (then dropped); without it the history is empty.
    The catalog is a broadcast dimension."""
    conf = retrieved.where("confident")
    ctx = dim_broadcast(cat.select("domain", F.col("context").alias("_domain_context")))
    p = conf.join(ctx, "domain", "left")
    none = F.array().cast(f"array<{MESSAGE}>")
    if isinstance(history, str):
        hist = F.coalesce(F.col(history), none)
    elif history is not None:
        p = p.join(history, list(keys), "left")
        hist = F.coalesce(F.col("history"), none)
    else:
        hist = none
    sys_msg = F.struct(F.lit("system").alias("role"),
                       system_prompt(F.coalesce("_domain_context", F.lit("")),
                                     format_context("chunks")).alias("content"))
    human = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))
    p = p.withColumn("prompt", F.concat(F.array(sys_msg), hist, F.array(human))).drop("_domain_context")
    return p.drop(history) if isinstance(history, str) else p


def route_answers(retrieved: DataFrame, answered: DataFrame | None = None,
                  keys: tuple[str, ...] = ("question_id", "domain")) -> DataFrame:
    """Not confident -> the fixed refusal and no sources; confident -> the model's
    answer (from ``answered``: keys..., answer) and the cited pages."""
    r = retrieved
    if answered is not None:
        r = r.join(answered.select(*keys, F.col("answer").alias("_model_answer")), list(keys), "left")
    else:
        r = r.withColumn("_model_answer", F.lit(None).cast("string"))
    return (r.withColumn("answer", F.when(F.col("confident"), F.col("_model_answer")).otherwise(F.lit(REFUSAL)))
             .withColumn("sources", cited_sources("chunks", "confident"))
             .drop("_model_answer"))


def answer_with(prompts: DataFrame, answer_udf, keys: tuple[str, ...] = ("question_id", "domain")) -> DataFrame:
    """Apply the user's pandas UDF (prompt array -> answer string) to each prompt."""
    return prompts.select(*keys, answer_udf(F.col("prompt")).alias("answer"))


def chat_responses(routed: DataFrame) -> DataFrame:
    """The response projection (answer, confident, sources, session_id, domain)."""
    return routed.select("answer", "confident", "sources", "session_id", "domain")


def with_defaults(df: DataFrame) -> DataFrame:
    """Defaults for missing fields: confident -> true, sources -> [], distance -> 1.0,
    page -> 'unknown' (as text)."""
    out = df
    if "confident" in df.columns:
        out = out.withColumn("confident", F.coalesce(F.col("confident"), F.lit(True)))
    if "sources" in df.columns:
        out = out.withColumn("sources", F.coalesce(F.col("sources"), F.array().cast("array<bigint>")))
    if "distance" in df.columns:
        out = out.withColumn("distance", F.coalesce(F.col("distance"), F.lit(1.0)))
    if "page" in df.columns:
        out = out.withColumn("page_text", page_text("page"))
    return out
