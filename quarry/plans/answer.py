"""Batch answers (R5): retrieve -> route -> prompt -> answer function -> sources.

The retrieval result is bounded (at most ``n`` chunks per request of a size-checked
batch) and feeds two branches (prompts for the confident requests, routing for all),
so it is persisted once instead of running the search twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.functions.ranges import kept
from quarry.operators import answers
from quarry.plans.search import Collection, retrieve


def answer_batch(requests: DataFrame, coll: Collection, cat: DataFrame, answer_udf,
                 history: DataFrame | None = None, **retrieve_kw) -> DataFrame:
    """Per request: confident, reason, chunks, prompt-derived answer (or the refusal)
    and the cited pages."""
    r = kept(retrieve(requests, coll, cat, **retrieve_kw))
    prompts = answers.build_prompts(r, cat, history)
    answered = answers.answer_with(prompts, answer_udf)
    return answers.route_answers(r, answered)
