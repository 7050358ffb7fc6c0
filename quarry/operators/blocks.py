"""Stored postings in blocks with bounds (B2, B5, J3, S3), and top-k that skips blocks.

A stored row is one (domain, term, block of 2^12 corpus positions): the postings of the block as three
arrays (offset in the block, f, dl), their number and ``max_tf``, the greatest BM25 term
factor in it. Rows are made by one exchange on (term, block), so a frequent term is spread over all tasks, and
every file is sorted by ``at`` = (hash of the term, block number), whose Parquet statistics skip row groups and
pages. Files follow from the bytes of the postings (AQE); a domain's directories (``term_bucket``, the leading bits of the
hash) are as many as its tokens ask for. The dictionary (``terms``: df, idf, max_tf, at, term_bucket) is sorted by the hash.

A batch of questions is answered by bounds (MaxScore over a batch):

1. each question's rarer terms are read whole, those that hold at least 1 - :data:`LEFT_OUT` of what its terms can
   score (and whatever another question of the batch reads); the k-th best partial sum is a floor under its k-th score;
2. where the bounds of the left out, frequent terms sum to less than the floor, only chunks whose sum plus that bound reaches
   the floor remain (elsewhere all do); bounds of the blocks drop more, and of the left out terms only the
   blocks of remaining chunks are read (all, where all chunks remain).

A scan is told, for each domain, the wanted keys (of terms: ``head``, ``at`` without the block), or beyond :data:`KEYS`
at most :data:`RANGES` ranges of ``at`` that hold them, as plain comparisons that reach the Parquet reader; a batch with more keys than :data:`MAX_KEYS`, or over more domains than
:data:`SCANS`, is told less. Scores of
all chunks that can be in the top k are complete and exact; a domain whose eps is negative is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.ranges import kept

BLOCK_BITS = 12
_BLOCK_NO_BITS, _HASH_BITS = 20, 43
RANGES = 128
#: Keys of a domain up to which a scan is given the keys themselves, and the setting that lets Spark hand so many to Parquet.
KEYS = 1500
#: Keys of one scan: Parquet looks at a list as a chain of comparisons, each on the stack of the one before.
IN_KEYS = 500
_IN_LIMIT = "spark.sql.parquet.pushdown.inFilterThreshold"
MAX_KEYS = 200_000
#: Domains up to which each has a scan with ranges of its own.
SCANS = 16
#: Tokens of a domain for each of its directories (a power of two of them).
BUCKET_TOKENS = 1 << 28
#: Share of a question's possible score that its frequent terms may hold to be left out at first.
LEFT_OUT = 0.1
#: Rounding of scores (6 digits) may not drop a tie.
SLACK = 1e-5
#: Parquet row groups and pages of the stored tables: small, so that ranges skip.
PARQUET = {"parquet.block.size": str(8 << 20), "parquet.page.size": str(32 << 10), "parquet.page.row.count.limit": "64"}


def term_hash(term: str | Column = "term") -> Column:
    """A skip key, never a substitute for the term."""
    return F.shiftrightunsigned(F.xxhash64(term), 64 - _HASH_BITS)


def term_at(term: str | Column = "term") -> Column:
    """``at`` of a term's block 0."""
    return F.shiftleft(term_hash(term), _BLOCK_NO_BITS)


def block_at(at: Column, block: Column) -> Column:
    return at + F.least(block, F.lit((1 << _BLOCK_NO_BITS) - 1))


def bucket(at: Column, tokens: Column) -> Column:
    """Directory of ``at`` within a domain of so many tokens: leading bits of the term's hash."""
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(tokens, F.lit(1)) / F.lit(BUCKET_TOKENS)))).cast("int")
    return F.call_function("shiftright", F.shiftright(at, _BLOCK_NO_BITS), F.lit(_HASH_BITS) - bits).cast("int")


def factor(f: Column, dl: Column, avgdl: Column, k1: float, b: float) -> Column:
    return f * F.lit(k1 + 1.0) / (f + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))


def to_blocks(postings: DataFrame, stats: DataFrame, k1: float, b: float, bits: int = BLOCK_BITS) -> DataFrame:
    """Block rows of ``postings(domain, chunk_pos, term, f, dl)``, sorted by (domain, bucket, at) in each partition."""
    dims = stats.select("domain", "avgdl", (F.col("n_chunks") * F.col("avgdl")).alias("tokens"))
    p = postings.join(F.broadcast(dims), "domain")  # one row per domain
    block = F.shiftright("chunk_pos", bits)
    p = p.select("domain", "term", block.alias("block"), "tokens",
                 F.struct((F.col("chunk_pos") - F.shiftleft(block, bits)).cast("int").alias("o"), F.col("f").cast("int").alias("f"),
                          F.col("dl").cast("int").alias("dl")).alias("p"),
                 factor(F.col("f"), F.col("dl"), F.col("avgdl"), k1, b).alias("tf"))
    p = p.groupBy("domain", "term", "block").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.array_sort(F.collect_list("p")).alias("p"), F.max("tokens").alias("tokens"))
    p = p.withColumn("at", block_at(term_at(), F.col("block"))).withColumn("term_bucket", bucket(F.col("at"), F.col("tokens")))
    return p.select("domain", "term_bucket", "at", F.shiftright("at", _BLOCK_NO_BITS).alias("head"), "term", "block", "n", "max_tf",
                    F.col("p.o").alias("o"), F.col("p.f").alias("f"), F.col("p.dl").alias("dl")).sortWithinPartitions("domain", "term_bucket", "at")


def write(postings: DataFrame, stats: DataFrame, idf: DataFrame, path: str, k1: float, b: float, replace) -> None:
    """``replace(df, path, *by)`` writes a partitioned table, replacing the partitions it holds."""
    dims = stats.select("domain", (F.col("n_chunks") * F.col("avgdl")).alias("tokens"))  # one row per domain
    replace(to_blocks(postings, stats, k1, b), f"{path}/postings", "domain", "term_bucket")
    made = postings.sparkSession.read.parquet(f"{path}/postings").join(F.broadcast(dims.select("domain")), "domain", "left_semi")
    words = idf.join(made.groupBy("domain", "term").agg(F.max("max_tf").alias("max_tf")), ["domain", "term"]).join(F.broadcast(dims), "domain")
    words = words.withColumn("at", term_at()).select("domain", term_hash().alias("hash"), "term", "df", "idf", "max_tf", "at",
                                                     bucket(F.col("at"), F.col("tokens")).alias("term_bucket"))
    replace(words.sortWithinPartitions("domain", "hash"), f"{path}/idf", "domain")


def ranges_of(starts: np.ndarray, ends: np.ndarray, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all [start, end]; the widest gaps stay open."""
    at = np.argsort(starts, kind="stable")
    starts, ends = starts[at], np.maximum.accumulate(ends[at])
    gap = starts[1:] - ends[:-1]
    cuts = np.flatnonzero(gap > 1)
    if len(cuts) >= most:
        cuts = np.sort(cuts[np.argsort(gap[cuts], kind="stable")[len(cuts) - most + 1:]])
    first, last = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(starts) - 1]))
    return list(zip(starts[first].tolist(), ends[last].tolist(), strict=True))


def condition(key: str, held: list[tuple[int, int]]) -> str:
    """SQL for ``key`` in one of the ascending ranges, as text (the parser balances a long OR)."""
    return " OR ".join(f"{key} BETWEEN {a} AND {z}" for a, z in held)


@dataclass
class Blocks:
    """Stored postings: ``rows`` (blocks), ``terms`` (dictionary). ``scans`` keeps the block scans of a batch for reports."""
    rows: DataFrame
    terms: DataFrame
    bits: int = BLOCK_BITS
    scans: list[DataFrame] = field(default_factory=list)

    @staticmethod
    def read(spark: SparkSession, path: str, domains: list[str] | None = None) -> "Blocks":
        def rd(name):
            df = spark.read.parquet(f"{path}/{name}")
            return df.where(F.col("domain").isin(domains)) if domains else df
        return Blocks(rd("postings"), rd("idf"))

    def postings(self, rows: DataFrame | None = None, *carry: str) -> DataFrame:
        """(domain, chunk_pos, term, f, dl, carry...) of block rows."""
        rows = self.rows if rows is None else rows
        one = rows.select("domain", "term", "block", *carry, F.explode(F.arrays_zip("o", "f", "dl")).alias("p"))
        return one.select("domain", (F.shiftleft("block", self.bits) + F.col("p.o")).alias("chunk_pos"), "term",
                          F.col("p.f").cast("long").alias("f"), F.col("p.dl").cast("long").alias("dl"), *carry)

    def within(self, table: DataFrame, wanted: DataFrame | pd.DataFrame, key: str, width: int = 1) -> DataFrame:
        """``table`` where ``key`` lies in the ranges of ``wanted(domain, key[, term_bucket])``, a bounded table; a wanted
        key stands for ``width`` keys."""
        cols = [c for c in ("domain", key, "term_bucket") if c in wanted.columns and c in table.columns]
        keys = wanted if isinstance(wanted, pd.DataFrame) else wanted.select(*cols).distinct().limit(MAX_KEYS + 1).toPandas()
        if len(keys) > MAX_KEYS:
            return table
        spark = table.sparkSession
        if int(spark.conf.get(_IN_LIMIT)) < KEYS:
            spark.conf.set(_IN_LIMIT, str(KEYS))
        keys = keys[keys["domain"].notna()]
        if not len(keys):
            return table.where(F.lit(False))

        def part(own):
            out = F.col("domain").isin(sorted(set(own["domain"])))
            if "term_bucket" in cols:
                out &= F.col("term_bucket").isin(sorted(int(x) for x in set(own["term_bucket"])))
            at = own[key].to_numpy()
            if len(own) <= KEYS:
                name, values = ("head", np.unique(at >> _BLOCK_NO_BITS).tolist()) if width > 1 else (key, np.unique(at).tolist())
                return reduce(DataFrame.unionAll, [table.where(out & F.col(name).isin(values[i:i + IN_KEYS])) for i in range(0, len(values), IN_KEYS)])
            return table.where(out).where(condition(key, ranges_of(at, at + (width - 1))))

        if keys["domain"].nunique() > SCANS:
            return part(keys)
        return reduce(DataFrame.unionAll, [part(own) for _, own in keys.groupby("domain")])


def with_terms(qt: DataFrame, index: Blocks, small: bool) -> DataFrame:
    """Question terms with the dictionary's columns; only their ranges of the dictionary are read."""
    qt = qt.withColumn("hash", term_hash())
    words = index.within(index.terms, qt, "hash") if small else index.terms
    return words.drop("hash").join(F.broadcast(qt.drop("hash")) if small else qt.drop("hash"), ["domain", "term"])


def _scored(index: Blocks, rows: DataFrame, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """Contributions (question_id, domain, chunk_pos, v) of ``terms`` over block rows."""
    post = index.postings(rows).join(F.broadcast(terms), ["domain", "term"])
    return post.select("question_id", "domain", "chunk_pos",
                       (F.col("qtf") * F.col("idf") * factor(F.col("f"), F.col("dl"), F.col("avgdl"), k1, b)).alias("v"))


def _floors(sums: DataFrame, k: int) -> DataFrame:
    """(question_id, domain, floor): the k-th best sum of a question that has so many."""
    w = Window.partitionBy("question_id", "domain").orderBy(F.desc("s"))
    best = sums.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    return best.groupBy("question_id", "domain").agg(F.count(F.lit(1)).alias("_n"), F.min("s").alias("floor")).where(F.col("_n") == k).drop("_n")


QUESTION_TERMS = ("question_id long, domain string, term string, at long, term_bucket int, qtf long, idf double, df long, "
                  "max_tf double, avgdl double, eps double")


def contributions(qidf: DataFrame, index: Blocks, k: int, k1: float, b: float) -> DataFrame:
    """(question_id, domain, chunk_pos, v): complete scores of every chunk that can be in the top k, as
    parts to be summed. ``qidf`` has the columns of :data:`QUESTION_TERMS` and is proven small: a batch is
    planned on the driver, a row per question and term."""
    spark, keys = qidf.sparkSession, ["question_id", "domain"]
    names = [c.split()[0] for c in QUESTION_TERMS.split(", ")]
    q = qidf.select(*names).toPandas().sort_values([*keys, "df", "term"], ascending=[True, True, False, True], ignore_index=True)
    q["ub"] = q["qtf"] * q["idf"] * q["max_tf"]
    by = q.groupby(keys, sort=False)
    q["left_out"] = (by["ub"].cumsum() < LEFT_OUT * by["ub"].transform("sum")) & ~(q["eps"].fillna(0.0) < 0)
    # a term that some question reads whole is read anyway
    whole_terms = q.loc[~q["left_out"], ["domain", "term"]].drop_duplicates()
    q["left_out"] &= q[["domain", "term"]].merge(whole_terms, "left", indicator="_m")["_m"].eq("left_only")
    table = lambda df: spark.createDataFrame(df[names].astype(object).where(df[names].notna(), None).values.tolist(), QUESTION_TERMS)
    read, left = table(q[~q["left_out"]]), table(q[q["left_out"]])
    limits = spark.createDataFrame(by.agg(bound=("ub", "sum"), least=("eps", "min")).reset_index()[[*keys, "least"]].merge(
        q[q["left_out"]].groupby(keys, sort=False).agg(bound=("ub", "sum")).reset_index(), "left", keys).fillna({"bound": 0.0})[
        [*keys, "bound", "least"]].astype(object).values.tolist(), "question_id long, domain string, bound double, least double")

    rows = index.within(index.rows, q[~q["left_out"]], "at", 1 << _BLOCK_NO_BITS)
    sums = kept(_scored(index, rows, read, k1, b).groupBy(*keys, "chunk_pos").agg(F.sum("v").alias("s")))
    # one row a question; without a floor (too few chunks, left out terms that can lift a chunk alone, negative idf) all remain
    limits = limits.join(_floors(sums, k), keys, "left").withColumn(
        "floor", F.when((F.col("bound") < F.col("floor")) & ~(F.coalesce(F.col("least"), F.lit(0.0)) < 0), F.col("floor"))).persist(StorageLevel.MEMORY_AND_DISK)
    near = sums.join(F.broadcast(limits), keys).where(F.col("floor").isNull() | (F.col("s") + F.col("bound") >= F.col("floor") - F.lit(SLACK)))
    near = near.withColumn("block", F.shiftright("chunk_pos", index.bits))
    whole = limits.where("floor IS NULL AND bound > 0").join(left, keys).select("domain", "term_bucket", "at", "term").distinct()
    # blocks of the left out terms that hold a remaining chunk, with that block's own bound
    spots = near.where("floor IS NOT NULL AND bound > 0").select(*keys, "block").distinct().join(
        left.select(*keys, "term", "at", "term_bucket", "qtf", "idf"), keys)
    spots = kept(spots.withColumn("at", block_at(F.col("at"), F.col("block"))))
    tops = index.within(index.rows, spots, "at").select("domain", "term", "block", "max_tf")
    bounds = (spots.join(tops, ["domain", "term", "block"])
              .groupBy(*keys, "block").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("max_tf")).alias("block_bound")))
    open_ = kept(near.join(bounds, [*keys, "block"], "left")
                 .where(F.col("floor").isNull() | (F.col("s") + F.coalesce("block_bound", F.lit(0.0)) >= F.col("floor") - F.lit(SLACK)))
                 .select(*keys, "chunk_pos", "block", "s", "floor", "bound"))
    some = spots.join(open_.select(*keys, "block").distinct(), [*keys, "block"], "left_semi").select("domain", "term_bucket", "at", "term").distinct()
    rest = []
    index.scans[:] = [rows]
    for wanted, width, own in ((whole, 1 << _BLOCK_NO_BITS, limits.where("floor IS NULL")), (some, 1, open_.where("floor IS NOT NULL AND bound > 0"))):
        part = index.within(index.rows, wanted, "at", width)
        index.scans.append(part)
        got = _scored(index, part, left, k1, b)
        on = keys if width > 1 else [*keys, "chunk_pos"]
        rest.append(got.join(own.select(*on), on, "left_semi"))
    return open_.select(*keys, "chunk_pos", F.col("s").alias("v")).unionByName(rest[0]).unionByName(rest[1])
