import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import ivf, vector

KINDS = "domain string, chunk_pos long, vec array<double>"


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = np.random.default_rng(1).standard_normal((24, 16)) * 3
    return [(["a", "a", "b", None][i % 4], i + seed * 100_000, [float(x) for x in base[rng.integers(24)] + rng.standard_normal(16)]) for i in range(n)]


def questions(df):
    return df.select(F.col("chunk_pos").alias("question_id"), "domain", F.col("vec").alias("qvec"), F.col("chunk_pos").alias("self_pos"))


def recall(got, want):
    key = lambda rows: {(r["question_id"], r["chunk_pos"]) for r in rows}
    return len(key(got) & key(want)) / len(key(want))


def brute(rows, asked, k):
    out = set()
    for d, p, v in asked:
        own = sorted((round(float(((np.array(v) - np.array(w)) ** 2).sum()), 6), q) for e, q, w in rows if e == d and q != p)
        out |= {(p, q) for _, q in own[:k]}
    return out


def test_recall_pairs_pruning_and_adding(spark, tmp_path):
    first, more = clustered(2400, 1), clustered(600, 2)
    df = spark.createDataFrame(first, KINDS).repartition(6)
    root = f"{tmp_path}/ivf"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small partitions share a task and its file
    try:
        ivf.build(df, root, recall=0.95, cell_rows=40)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    settings = spark.read.parquet(f"{root}/settings").first()
    assert settings["recall"] >= 0.95
    qs = questions(df.where("chunk_pos % 7 = 0"))
    got = ivf.search(qs, root, exclude_self=True).collect()
    want = brute(first, [r for r in first if r[1] % 7 == 0], 10)
    assert len({(r["question_id"], r["chunk_pos"]) for r in got} & want) / len(want) >= 0.9
    # under a tenth of the same-domain pairs are compared
    q, v = ivf.candidates(qs, root, exclude_self=True)
    pairs = q.groupBy("domain").count().join(v.groupBy("domain").agg(F.count(F.lit(1)).alias("n")), "domain").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    size = {r["d"]: r["n"] for r in df.groupBy(F.coalesce("domain", F.lit("-")).alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    every = sum(size[r["d"]] for r in qs.select(F.coalesce("domain", F.lit("-")).alias("d")).collect())
    assert pairs < 0.1 * every, (pairs, every)
    # one question opens the directories of its own cells only
    plan = ivf.candidates(qs.where("domain = 'a'").limit(1), root)[1]._jdf.queryExecution().executedPlan().toString()
    part = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "domain" in part and "cell" in part
    # a cell larger than cell_rows lies in several files
    files = spark.read.parquet(f"{root}/vectors").select("domain", "cell", F.input_file_name().alias("f")).groupBy("domain", "cell").agg(F.count_distinct("f").alias("n"))
    assert files.agg(F.max("n")).first()[0] > 1
    # added vectors are found
    ivf.add(spark.createDataFrame(more, KINDS), root)
    probes, got = ivf.recalibrate(spark, root)
    assert got >= 0.95
    both = spark.createDataFrame(first + more, KINDS)
    qs = questions(both.where("chunk_pos % 7 = 0"))
    found = {(r["question_id"], r["chunk_pos"]) for r in ivf.search(qs, root, exclude_self=True).collect()}
    want = brute(first + more, [r for r in first + more if r[1] % 7 == 0], 10)
    assert len(found & want) / len(want) >= 0.9 and any(p > 200_000 for _, p in found)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_tiny_tables(spark, tmp_path, n):
    rows = [("a", i, [float(i), 1.0]) for i in range(n)]
    df = spark.createDataFrame(rows, KINDS)
    ivf.build(df, f"{tmp_path}/i")
    qs = spark.createDataFrame([(9, "a", [0.0, 1.0]), (8, "z", [0.0, 1.0])], "question_id long, domain string, qvec array<double>")
    got = ivf.search(qs, f"{tmp_path}/i", probes=10).collect()
    assert [(r["question_id"], r["chunk_pos"]) for r in sorted(got, key=lambda r: r["rank"])] == [(9, i) for i in range(n)]
