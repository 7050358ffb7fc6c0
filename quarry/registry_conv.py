"""Registered queries: query log, reports, conversation state, answer preparation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quarry.operators import answers, reports, sessions
from quarry.plans import search
from quarry.registry import PAGES_CTE, RETRIEVE_CTE, register
from quarry.session import shared_dir
from quarry.sources import log_batches, querylog
from quarry.sources.testdata import RESET_EVENT, SourceTables

TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
REFUSAL_SQL = answers.REFUSAL.replace("'", "''")

EVENTS_CTE = f"""
ev AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS session_id, event_type AS domain, props AS question,
         value < 20 AS confident
  FROM events),
turns AS (
  SELECT *, CASE WHEN confident THEN 'Answer to: ' || question ELSE '{REFUSAL_SQL}' END AS answer
  FROM ev WHERE domain <> 'signup'),
resets AS (SELECT * FROM ev WHERE domain = 'signup')"""


def _ts(c="timestamp"):
    return F.date_format(F.col(c), TS_TEXT)


# ---------------------------------------------------------------- log and reports
@register("queries_per_domain", f"WITH {EVENTS_CTE} SELECT domain, count(*) AS query_count FROM turns GROUP BY domain")
def q_queries_per_domain(spark, sf_dir):
    return reports.queries_per_domain(SourceTables(spark, sf_dir).query_log())


@register("confidence_rate", f"""WITH {EVENTS_CTE}
SELECT domain, count(*) FILTER (WHERE confident) AS confident_count, count(*) AS total,
       round(count(*) FILTER (WHERE confident) / count(*) * 100, 1) AS confidence_rate_pct
FROM turns GROUP BY domain""")
def q_confidence_rate(spark, sf_dir):
    return reports.confidence_rate(SourceTables(spark, sf_dir).query_log())


@register("recent_questions", f"""WITH {EVENTS_CTE}
SELECT {TS_SQL.format(c='ts')} AS timestamp, domain, question, event_id
FROM turns ORDER BY ts DESC, event_id DESC LIMIT 5""")
def q_recent_questions(spark, sf_dir):
    r = reports.recent_questions(SourceTables(spark, sf_dir).query_log(), 5, tie_break="event_id")
    return r.select(_ts().alias("timestamp"), "domain", "question", "event_id")


@register("recent_questions_sql", f"""WITH {EVENTS_CTE}
SELECT {TS_SQL.format(c='ts')} AS timestamp, domain, question
FROM turns ORDER BY ts DESC, session_id, domain, question LIMIT 5""")
def q_recent_questions_sql(spark, sf_dir):
    """A3 as the report's SQL text over a temp view (timestamps are unique in the log)."""
    r = reports.run_report_sql(SourceTables(spark, sf_dir).query_log(), "recent_questions")
    return r.select(_ts().alias("timestamp"), "domain", "question")


@register("log_day", f"WITH {EVENTS_CTE} SELECT event_id, strftime(ts, '%Y-%m-%d') AS log_date FROM turns")
def q_log_day(spark, sf_dir):
    return SourceTables(spark, sf_dir).query_log().select("event_id", querylog.log_day("timestamp").alias("log_date"))


@register("to_json_log", f"""WITH {EVENTS_CTE}
SELECT event_id, to_json(struct_pack(
  timestamp := CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00'
                    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END,
  session_id := session_id, domain := domain, question := question, answer := answer,
  confident := confident))::VARCHAR AS json
FROM turns""")
def q_to_json_log(spark, sf_dir):
    return querylog.to_json_line(SourceTables(spark, sf_dir).query_log(), keep=["event_id"])


@register("log_roundtrip", f"""WITH {EVENTS_CTE}
SELECT {TS_SQL.format(c='ts')} AS timestamp, session_id, domain, question, answer, confident,
       strftime(ts, '%Y-%m-%d') AS log_date
FROM turns""")
def q_log_roundtrip(spark, sf_dir):
    """S5 then S6: append the log to day partitions in the shared folder and read it back."""
    path = shared_dir(spark, "query-log")
    querylog.write_log(SourceTables(spark, sf_dir).query_log(), path)
    back = querylog.read_log(spark, path)
    return back.select(_ts().alias("timestamp"), "session_id", "domain", "question", "answer", "confident",
                       "log_date")


@register("log_batches", f"""WITH {EVENTS_CTE}
SELECT {TS_SQL.format(c='ts')} AS timestamp, session_id, domain, question, answer, confident,
       strftime(ts, '%Y-%m-%d') AS log_date, CASE WHEN confident THEN '01' ELSE 'refused' END AS batch
FROM turns""")
def q_log_batches(spark, sf_dir):
    """S5 by repeatable batches: one is run twice, one again after a run that died before its commit."""
    root, log = shared_dir(spark, "log-batches"), SourceTables(spark, sf_dir).query_log()
    for _ in range(2):
        log_batches.append_batch(log.where("confident"), root, "01")
    log_batches.write_records(log, root, "refused")  # never committed: replaced by the next
    log_batches.append_batch(log.where("not confident"), root, "refused")
    return log_batches.read_batches(spark, root).select(_ts().alias("timestamp"), "session_id", "domain", "question", "answer",
                                                        "confident", "log_date", "batch")


@register("message_counts", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) AS message_count FROM conversations GROUP BY conv_id""")
def q_message_counts(spark, sf_dir):
    return reports.message_counts(SourceTables(spark, sf_dir).messages())


# ---------------------------------------------------------------- conversation state
@register("session_keys", f"WITH {EVENTS_CTE} SELECT event_id, session_id || ':' || domain AS session_key FROM turns")
def q_session_keys(spark, sf_dir):
    return SourceTables(spark, sf_dir).turns().select("event_id", sessions.session_key().alias("session_key"))


@register("session_starts", f"""WITH {EVENTS_CTE}
SELECT session_id || ':' || domain AS session_key, arg_min(event_id, (ts, event_id)) AS first_event_id,
       {TS_SQL.format(c='min(ts)')} AS first_timestamp
FROM turns GROUP BY session_id, domain""")
def q_session_starts(spark, sf_dir):
    s = sessions.session_starts(SourceTables(spark, sf_dir).turns())
    return s.select("session_key", "first_event_id", _ts("first_timestamp").alias("first_timestamp"))


@register("turn_messages", f"""WITH {EVENTS_CTE}
SELECT event_id, 0 AS part, 'user' AS role, question AS content FROM turns
UNION ALL SELECT event_id, 1, 'assistant', answer FROM turns""")
def q_turn_messages(spark, sf_dir):
    return sessions.turn_messages(SourceTables(spark, sf_dir).turns()).drop("session_id", "domain")


@register("chat_history", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq,
       CAST(count(*) OVER w AS BIGINT) AS history_len,
       coalesce(to_json(list(struct_pack(role := role, content := text)) OVER w)::VARCHAR, '[]') AS history
FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q_chat_history(spark, sf_dir):
    h = sessions.chat_history(SourceTables(spark, sf_dir).messages())
    return h.select("session_id", "seq", F.size("history").cast("long").alias("history_len"),
                    F.to_json("history").alias("history"))


@register("chat_history_last", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq,
       CAST(count(*) OVER w AS BIGINT) AS history_len,
       coalesce(to_json(list(struct_pack(role := role, content := text)) OVER w)::VARCHAR, '[]') AS history
FROM conversations
WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def q_chat_history_last(spark, sf_dir):
    """W2 with the optional last-n history (n = 4), computed bucket-locally."""
    h = sessions.chat_history_last(SourceTables(spark, sf_dir).messages(), 4, width=8)
    return h.select("session_id", "seq", F.size("history").cast("long").alias("history_len"),
                    F.to_json("history").alias("history"))


@register("history_with_reset", f"""WITH {EVENTS_CTE},
ep AS (
  SELECT *, CAST(sum(CASE WHEN domain = 'signup' THEN 1 ELSE 0 END)
                 OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch
  FROM ev)
SELECT event_id, session_id, domain, epoch,
       CAST(row_number() OVER (PARTITION BY session_id, domain, epoch ORDER BY ts, event_id) - 1 AS BIGINT) AS turn_no,
       CAST(2 * (row_number() OVER (PARTITION BY session_id, domain, epoch ORDER BY ts, event_id) - 1) AS BIGINT) AS history_len
FROM ep WHERE domain <> 'signup'""")
def q_history_with_reset(spark, sf_dir):
    r = SourceTables(spark, sf_dir).requests()
    h = sessions.history_positions(r, F.col("domain") == F.lit(RESET_EVENT))
    return h.select("event_id", "session_id", "domain", "epoch", "turn_no", "history_len")


@register("conversation_segments", f"""WITH {EVENTS_CTE},
lg AS (SELECT *, lag(domain) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM turns)
SELECT event_id, session_id, domain,
       CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> domain THEN 1 ELSE 0 END)
            OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
FROM lg""")
def q_conversation_segments(spark, sf_dir):
    s = sessions.conversation_segments(SourceTables(spark, sf_dir).turns())
    return s.select("event_id", "session_id", "domain", "segment")


@register("reset_report", f"""WITH {EVENTS_CTE},
starts AS (SELECT session_id, domain, min((ts, event_id)) AS f FROM turns GROUP BY session_id, domain)
SELECT r.session_id, r.event_id AS reset_id,
       coalesce(string_agg(s.domain, ',' ORDER BY reverse(s.domain)) FILTER (WHERE s.f < (r.ts, r.event_id)), '') AS cleared
FROM resets r LEFT JOIN starts s USING (session_id)
GROUP BY r.session_id, r.event_id""")
def q_reset_report(spark, sf_dir):
    t = SourceTables(spark, sf_dir)
    # a catalog order that is not the alphabet: by the reversed names
    names = t.turns().select("domain").distinct()
    order = names.withColumn("ord", F.row_number().over(Window.orderBy(F.reverse("domain"))))
    rep = sessions.reset_report(t.turns(), t.resets(), order)
    return rep.select("session_id", "reset_id", F.array_join("cleared", ",").alias("cleared"))


@register("new_session_ids", f"""WITH {EVENTS_CTE}
SELECT event_id, session_id, true AS well_formed, true AS fresh FROM resets""")
def q_new_session_ids(spark, sf_dir):
    """H5: a new short id per reset; the ids are random, so the check is on their form: eight
    hexadecimal digits, another id than the session's."""
    ids = sessions.new_session_ids(SourceTables(spark, sf_dir).resets().select("event_id", "session_id"))
    return ids.select("event_id", "session_id", F.col("new_session_id").rlike("^[0-9a-f]{8}$").alias("well_formed"),
                      (F.col("new_session_id") != F.col("session_id")).alias("fresh"))


# ---------------------------------------------------------------- catalog, validity, blanks
@register("list_domains", "SELECT t.ord, t.domain, t.description, count(d.lang) AS n_pages "
          "FROM (VALUES (0, 'en', 'English documents — invented prose'), "
          "(1, 'fr', 'French documents — invented prose'), (2, 'de', 'German documents — invented prose'), "
          "(3, 'es', 'Spanish documents — invented prose'), (4, 'it', 'Italian documents — invented prose')) "
          "t(ord, domain, description) LEFT JOIN documents d ON d.lang = t.domain GROUP BY ALL")
def q_list_domains(spark, sf_dir):
    from quarry.sources.domains import list_domains
    t = SourceTables(spark, sf_dir)
    return list_domains(t.catalog(), t.table("documents").select(F.col("lang").alias("domain")))


@register("missing_sources", f"""WITH {PAGES_CTE}
SELECT CAST(ord AS INTEGER) AS ord, domain, domain AS file, 'WARNING: ' || domain || ' not found. Skipping.' AS warning
FROM cat WHERE domain NOT IN (SELECT DISTINCT file FROM pages)""")
def q_missing_sources(spark, sf_dir):
    from quarry.sources.corpus import missing_sources
    t = SourceTables(spark, sf_dir)
    return missing_sources(t.catalog(), t.pages())


@register("validate_requests", f"""WITH {PAGES_CTE},
avail AS (SELECT '[' || string_agg('''' || domain || '''', ', ' ORDER BY ord) || ']' AS a FROM cat)
SELECT question_id, domain, domain IN (SELECT domain FROM cat) AS valid,
       CASE WHEN domain IN (SELECT domain FROM cat) THEN NULL
            ELSE 'Unknown domain ''' || domain || '''. Available: ' || (SELECT a FROM avail) END AS reason
FROM questions""")
def q_validate_requests(spark, sf_dir):
    t = SourceTables(spark, sf_dir)
    return search.validate(t.questions(), t.catalog()).select("question_id", "domain", "valid", "reason")


@register("drop_blank_questions", f"""WITH {PAGES_CTE}
SELECT question_id, domain FROM questions WHERE trim(regexp_replace(question, '\\s+', ' ', 'g')) <> ''""")
def q_drop_blank_questions(spark, sf_dir):
    from quarry.functions.text import is_blank
    q = SourceTables(spark, sf_dir).questions()
    return q.where(~is_blank("question")).select("question_id", "domain")


# ---------------------------------------------------------------- gate, routing, prompts, answers
def _retrieved(spark, sf_dir):
    t = SourceTables(spark, sf_dir)
    return t, search.retrieve(t.questions(), t.collection(), t.catalog())


@register("confidence_gate", f"WITH {RETRIEVE_CTE} SELECT question_id, domain, top_distance, confident, reason "
          "FROM retrieved WHERE top_distance IS NOT NULL")
def q_confidence_gate(spark, sf_dir):
    t = SourceTables(spark, sf_dir)
    hits = search.hybrid_search(t.questions(), t.collection())
    top = hits.where(F.col("rank") == 0).select("question_id", "domain", F.col("distance").alias("top_distance"))
    conf, reason = search.gate(F.col("top_distance"))
    return top.select("question_id", "domain", "top_distance", conf.alias("confident"), reason.alias("reason"))


CTX_SQL = """string_agg('[Source ' || (h.rank + 1) || ' | Page ' || coalesce(CAST(h.page AS VARCHAR), 'unknown')
                  || ']' || chr(10) || h.content, chr(10) || chr(10) ORDER BY h.rank)"""
ANSWERED_CTE = RETRIEVE_CTE + f""",
ctx AS (SELECT h.question_id, h.domain, {CTX_SQL} AS context,
               list_sort(list_distinct(list(h.page))) AS pages
        FROM hybrid h GROUP BY h.question_id, h.domain),
routed AS (
  SELECT r.question_id, r.domain, r.confident,
         CASE WHEN r.confident THEN 'Answer to: ' || q.question ELSE '{REFUSAL_SQL}' END AS answer,
         CASE WHEN r.confident THEN array_to_string(c.pages, ',') ELSE '' END AS sources
  FROM retrieved r JOIN questions q USING (question_id, domain) LEFT JOIN ctx c USING (question_id, domain))"""


def _srcs(c="sources"):
    return F.array_join(F.transform(F.col(c), lambda p: p.cast("string")), ",")


@register("format_context", f"WITH {ANSWERED_CTE} SELECT question_id, domain, context FROM ctx")
def q_format_context(spark, sf_dir):
    t, r = _retrieved(spark, sf_dir)
    return (r.where(F.size("chunks") > 0)
             .select("question_id", "domain", answers.format_context("chunks").alias("context")))


@register("cited_sources", f"WITH {ANSWERED_CTE} SELECT question_id, domain, sources FROM routed")
def q_cited_sources(spark, sf_dir):
    t, r = _retrieved(spark, sf_dir)
    return r.select("question_id", "domain", _srcs_expr(r).alias("sources"))


def _srcs_expr(r):
    return F.array_join(F.transform(answers.cited_sources("chunks", "confident"), lambda p: p.cast("string")), ",")


def _test_answer_udf():
    from quarry.sources.testdata import TEST_ANSWER_PREFIX

    @pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        # deterministic stand-in for the model: answers the last (human) message
        return prompts.map(lambda msgs: TEST_ANSWER_PREFIX + msgs[-1]["content"])
    return answer


def _batch(spark, sf_dir):
    from quarry.plans.answer import answer_batch
    t = SourceTables(spark, sf_dir)
    return answer_batch(t.questions(), t.collection(), t.catalog(), _test_answer_udf())


@register("route_answers", f"WITH {ANSWERED_CTE} SELECT question_id, domain, confident, answer, sources FROM routed")
def q_route_answers(spark, sf_dir):
    t, r = _retrieved(spark, sf_dir)
    routed = answers.route_answers(r, r.where("confident").select(
        "question_id", "domain", F.concat(F.lit("Answer to: "), F.col("question")).alias("answer")))
    return routed.select("question_id", "domain", "confident", "answer", _srcs().alias("sources"))


@register("batch_answers", f"WITH {ANSWERED_CTE} SELECT question_id, domain, confident, answer, sources FROM routed")
def q_batch_answers(spark, sf_dir):
    """Retrieve -> route -> prompt -> answer function (pandas UDF) -> sources."""
    b = _batch(spark, sf_dir)
    return b.select("question_id", "domain", "confident", "answer", _srcs().alias("sources"))


@register("chat_responses", f"""WITH {ANSWERED_CTE}
SELECT answer, confident, sources, CAST(question_id AS VARCHAR) AS session_id, domain FROM routed""")
def q_chat_responses(spark, sf_dir):
    b = _batch(spark, sf_dir).withColumn("session_id", F.col("question_id").cast("string"))
    return answers.chat_responses(b).withColumn("sources", _srcs())


SYS_HEAD, _rest = answers.SYSTEM_TEMPLATE.split("{domain_context}")
SYS_MID, SYS_END = _rest.split("{context}")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register("build_prompts", f"""WITH {ANSWERED_CTE},
dctx AS (SELECT * FROM (VALUES ('en', 'the English document collection'), ('fr', 'the French document collection'),
                               ('de', 'the German document collection'), ('es', 'the Spanish document collection'), ('it', 'the Italian document collection'))
         t(domain, dc))
SELECT r.question_id, r.domain, 2 AS n_messages,
       {_sql_text(SYS_HEAD)} || d.dc || {_sql_text(SYS_MID)} || c.context || {_sql_text(SYS_END)} AS system_prompt,
       q.question AS human
FROM retrieved r JOIN questions q USING (question_id, domain) JOIN ctx c USING (question_id, domain)
JOIN dctx d USING (domain) WHERE r.confident""")
def q_build_prompts(spark, sf_dir):
    t, r = _retrieved(spark, sf_dir)
    p = answers.build_prompts(r, t.catalog())
    return p.select("question_id", "domain", F.size("prompt").alias("n_messages"),
                    F.col("prompt")[0]["content"].alias("system_prompt"),
                    F.element_at("prompt", -1)["content"].alias("human"))


@register("default_fields", f"""WITH {ANSWERED_CTE}
SELECT h.question_id, h.domain, h.rank, CASE WHEN h.rank % 3 = 1 THEN 'unknown' ELSE CAST(h.page AS VARCHAR) END AS page_text,
       CASE WHEN h.rank % 3 = 2 THEN 1.0 ELSE h.distance END AS distance, h.rank % 2 = 1 OR r.confident AS confident,
       CASE WHEN h.rank % 2 = 0 THEN '' ELSE CAST(h.page AS VARCHAR) END AS sources
FROM hybrid h JOIN retrieved r USING (question_id, domain)""")
def q_default_fields(spark, sf_dir):
    t = SourceTables(spark, sf_dir)
    h = search.hybrid_search(t.questions(), t.collection())
    top = h.where("rank = 0").select("question_id", "domain", search.gate(F.col("distance"))[0].alias("_conf"))
    # some fields of every hit go missing, so that each default fires
    h = h.join(top, ["question_id", "domain"]).select(
        "question_id", "domain", "rank", F.when(F.col("rank") % 2 == 0, F.col("_conf")).alias("confident"),
        F.when(F.col("rank") % 2 == 1, F.array("page")).alias("sources"),
        F.when(F.col("rank") % 3 != 1, F.col("page")).alias("page"),
        F.when(F.col("rank") % 3 != 2, F.col("distance")).alias("distance"))
    return answers.with_defaults(h).select("question_id", "domain", "rank", "page_text", "distance", "confident",
                                           _srcs().alias("sources"))


@register("valid_requests", f"WITH {PAGES_CTE} SELECT question_id, domain FROM questions "
          "WHERE domain IN (SELECT domain FROM cat)")
def q_valid_requests(spark, sf_dir):
    """Requests whose domain is in the catalog (left semi join)."""
    t = SourceTables(spark, sf_dir)
    return t.questions().join(F.broadcast(t.catalog().select("domain")), "domain", "left_semi") \
            .select("question_id", "domain")


@register("invalid_requests", f"WITH {PAGES_CTE} SELECT question_id, domain FROM questions "
          "WHERE domain NOT IN (SELECT domain FROM cat)")
def q_invalid_requests(spark, sf_dir):
    """Requests for an unknown domain (left anti join)."""
    t = SourceTables(spark, sf_dir)
    return t.questions().join(F.broadcast(t.catalog().select("domain")), "domain", "left_anti") \
            .select("question_id", "domain")


# ---------------------------------------------------------------- conversations about the documents
CHAT_CTE = ANSWERED_CTE + f""",
chat AS (
  SELECT e.event_id, e.ts, CAST(e.user_id AS VARCHAR) AS session_id, e.event_type = 'signup' AS is_reset, q.question_id,
         CASE (e.event_id // 7) % 2 WHEN 0 THEN 'en' ELSE 'fr' END AS domain, q.question,
         CASE WHEN e.value < 20 THEN 'Answer to: ' || q.question ELSE '{REFUSAL_SQL}' END AS answer
  FROM events e JOIN (SELECT CAST(item_id AS BIGINT) AS question_id, text AS question FROM benchmark) q
    ON q.question_id = e.event_id % (SELECT count(*) FROM benchmark)),
chat_epochs AS (
  SELECT *, sum(CASE WHEN is_reset THEN 1 ELSE 0 END)
            OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM chat),
chat_turns AS (
  SELECT *, count(*) OVER w AS turn_no,
         coalesce(string_agg('user=' || question || chr(10) || 'assistant=' || answer, chr(10)) OVER w, '') AS history
  FROM chat_epochs WHERE NOT is_reset
  WINDOW w AS (PARTITION BY session_id, domain, epoch ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register("session_prompts", f"""WITH {CHAT_CTE},
dctx AS (SELECT * FROM (VALUES ('en', 'the English document collection'), ('fr', 'the French document collection')) t(domain, dc))
SELECT t.event_id, t.session_id, t.domain, CAST(2 + 2 * t.turn_no AS INTEGER) AS n_messages, md5(t.history) AS history_md5,
       md5({_sql_text(SYS_HEAD)} || d.dc || {_sql_text(SYS_MID)} || c.context || {_sql_text(SYS_END)}) AS system_md5, t.question AS last_message
FROM chat_turns t JOIN retrieved r USING (question_id, domain) JOIN ctx c USING (question_id, domain)
JOIN dctx d USING (domain) WHERE r.confident""")
def q_session_prompts(spark, sf_dir):
    """R4 + W2 + W3: prompts with the history of the request's session, domain and epoch."""
    from quarry.plans.conversation import session_prompts
    t = SourceTables(spark, sf_dir)
    p = session_prompts(t.chat_requests(), F.col("is_reset"), t.collection(), t.catalog())
    past = F.transform(F.slice("prompt", 2, F.size("prompt") - 2), lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return p.select("event_id", "session_id", "domain", F.size("prompt").alias("n_messages"),
                    F.md5(F.array_join(past, "\n")).alias("history_md5"),
                    F.md5(F.col("prompt")[0]["content"]).alias("system_md5"),
                    F.element_at("prompt", -1)["content"].alias("last_message"))


@register("chat_log", f"""WITH {CHAT_CTE}
SELECT {TS_SQL.format(c='t.ts')} AS timestamp, t.session_id, t.domain, t.question, r.answer, r.confident,
       strftime(t.ts, '%Y-%m-%d') AS log_date
FROM chat_turns t JOIN routed r USING (question_id, domain)""")
def q_chat_log(spark, sf_dir):
    """R5 + P7 + S5: answer a batch of conversations, append it to the log, read the log."""
    from quarry.plans.conversation import log_records
    t = SourceTables(spark, sf_dir)
    path = shared_dir(spark, "chat-log")
    records = log_records(t.chat_requests(), F.col("is_reset"), t.collection(), t.catalog(), _test_answer_udf(), stamp=False)
    querylog.write_log(records, path)
    return querylog.read_log(spark, path).select(_ts().alias("timestamp"), "session_id", "domain", "question", "answer",
                                                 "confident", "log_date")
