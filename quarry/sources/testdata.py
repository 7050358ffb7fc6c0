"""Mapping of the driver's parquet tables onto the engine's inputs.

documents(doc_id, text, lang, ...)  -> pages: domain = file = lang, page = position by doc_id
benchmark(item_id, text)            -> questions, each asked of every request domain
embeddings(vec_id, embedding, label)-> stored vectors; domain = label
events(event_id, ts, user_id, event_type, value, props) -> query log:
    session_id = user_id, domain = event_type, question = props, confident = value < 20,
    reset marker = event_type 'signup'
conversations(conv_id, turn, role, text) -> message history: session = conv_id, seq = turn
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.ranges import kept
from quarry.sources import corpus as corpus_src
from quarry.sources.domains import catalog

# The catalog used with the test tables. 'it' has no documents (its source
# is missing); 'xx' is asked for but not catalogued (such requests are invalid).
LANG_DOMAINS = [
    ("en", "en", "English documents — invented prose", "the English document collection",
     "EN English collection", "English-language pages", "ENGLISH"),
    ("fr", "fr", "French documents — invented prose", "the French document collection",
     "FR French collection", "French-language pages", "FRENCH"),
    ("de", "de", "German documents — invented prose", "the German document collection",
     "DE German collection", "German-language pages", "GERMAN"),
    ("es", "es", "Spanish documents — invented prose", "the Spanish document collection",
     "ES Spanish collection", "Spanish-language pages", "SPANISH"),
    ("it", "it", "Italian documents — invented prose", "the Italian document collection",
     "IT Italian collection", "Italian-language pages", "ITALIAN"),
]
# Every benchmark question is asked of each of these domains.
REQUEST_DOMAINS = ["en", "fr", "de", "es", "it", "xx"]
# The log mapping.
CONFIDENT_BELOW = 20.0
RESET_EVENT = "signup"
# The languages that the chat requests ask.
CHAT_DOMAINS = ["en", "fr"]
# The deterministic stand-in for the language model used by tests.
TEST_ANSWER_PREFIX = "Answer to: "


# Opened corpora / collections per (application, table folder): opened once per session
# and reused by every query, as a served collection is.
_OPENED: dict[tuple, object] = {}


class SourceTables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        # Log days and ISO timestamps are UTC by definition (as in the original).
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def _once(self, name: str, make):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _OPENED:
            _OPENED[key] = make()
        return _OPENED[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def catalog(self) -> DataFrame:
        return catalog(self.spark, LANG_DOMAINS)

    def pages(self) -> DataFrame:
        return corpus_src.load_pages(self.table("documents"), "lang", "lang", "doc_id", "text")

    def corpus(self) -> DataFrame:
        """One chunk per page, catalogued domains with pages only."""
        return self._once("corpus", lambda: kept(corpus_src.pages_as_chunks(self.pages(), self.catalog())))

    def collection(self):
        """Chunks + hash vectors + BM25 index of the corpus, cached for reuse."""
        from quarry.plans.search import build_collection
        return self._once("collection", lambda: build_collection(self.corpus()).persist())

    def questions(self) -> DataFrame:
        return corpus_src.questions_for_domains(self.table("benchmark"), "item_id", "text", REQUEST_DOMAINS)

    def requests(self) -> DataFrame:
        """events as chat requests in arrival order; 'signup' rows are resets."""
        return requests_from_events(self.table("events"))

    def turns(self) -> DataFrame:
        """Answered requests (resets excluded) with the deterministic test answer."""
        return turns_from_requests(self.requests())

    def chat_requests(self) -> DataFrame:
        """events as conversations about the documents: a request asks one benchmark question
        of one language, by its event id; its recorded answer is the test answer of that question, or the refusal
        where the event was not confident. 'signup' rows are resets."""
        from quarry.operators.answers import REFUSAL
        items = self.table("benchmark").select(F.col("item_id").cast("long").alias("question_id"), F.col("text").alias("question"))
        # one number: how many questions there are (ids are 0..n-1)
        n = items.count()
        langs = F.array(*[F.lit(d) for d in CHAT_DOMAINS])
        r = self.requests().drop("question").withColumn("is_reset", F.col("domain") == F.lit(RESET_EVENT))
        r = r.withColumn("question_id", F.pmod("event_id", F.lit(n))).withColumn(
            "domain", F.element_at(langs, (F.pmod(F.floor(F.col("event_id") / 7), F.lit(len(CHAT_DOMAINS))) + 1).cast("int")))
        r = r.join(items, "question_id")
        return r.withColumn("answer", F.when(F.col("confident"), F.concat(F.lit(TEST_ANSWER_PREFIX), F.col("question")))
                                       .otherwise(F.lit(REFUSAL))).drop("confident")

    def resets(self) -> DataFrame:
        return self.requests().where(F.col("domain") == F.lit(RESET_EVENT))

    def query_log(self) -> DataFrame:
        """The log of answered requests (events as the query log)."""
        return self.turns().select("event_id", "timestamp", "session_id", "domain", "question", "answer",
                                   "confident")

    def vectors(self) -> DataFrame:
        e = self.table("embeddings")
        return e.select(F.col("label").cast("string").alias("domain"),
                        F.col("vec_id").cast("long").alias("chunk_pos"), "embedding")

    def messages(self) -> DataFrame:
        c = self.table("conversations")
        return c.select(F.col("conv_id").cast("string").alias("session_id"),
                        F.col("turn").cast("long").alias("seq"), "role", F.col("text").alias("content"))


def requests_from_events(e: DataFrame) -> DataFrame:
    """Projection of the events table (batch or stream) onto chat requests."""
    return e.select(
            F.col("event_id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.col("user_id").cast("string").alias("session_id"),
            F.col("event_type").alias("domain"),
            F.col("props").alias("question"),
            (F.col("value") < F.lit(CONFIDENT_BELOW)).alias("confident"))


def turns_from_requests(r: DataFrame) -> DataFrame:
    """Answered requests (resets excluded) with the deterministic test answer."""
    from quarry.operators.answers import REFUSAL
    r = r.where(F.col("domain") != F.lit(RESET_EVENT))
    return r.withColumn("answer", F.when(F.col("confident"), F.concat(F.lit(TEST_ANSWER_PREFIX), F.col("question")))
                                   .otherwise(F.lit(REFUSAL)))
