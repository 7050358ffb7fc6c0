"""Columns of the input keep their values whatever their names."""

import corpus_pipeline
from quarry.llm import common, mixing, prob_minhash, quality

NAMES = ["_s", "_blocks", "_cut", "_block", "_place", "_n", "_id", "_kept", "_score", "_S", "n_words", "a", "weight"]


def rows(spark):
    own = [n for n in NAMES if n != "_S"]
    data = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "ab"[i % 2], *[100 * i + k for k in range(len(own))]) for i in range(40)]
    return spark.createDataFrame(data, ["doc_id", "text", "source", *own]), sorted(data)


def test_fresh():
    assert common.fresh(["_N", "x"], "_n", "y", "_n") == ["__n", "y", "___n"]


def test_mixing_near_duplicates_and_quality_keep_columns(spark):
    docs, data = rows(spark)
    got = mixing.mix(docs, block="turn", at="spot", max_repeat=1.0, cover=True).select(*docs.columns)
    assert sorted(tuple(r) for r in got.distinct().collect()) == data
    assert sorted(tuple(r) for r in corpus_pipeline.mixing_stage(spark, docs, "").distinct().collect()) == data
    assert sorted(tuple(r) for r in prob_minhash.drop_near_duplicates(docs).collect()) == data
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in quality.keep_quality(docs, labels, threshold=-1.0).collect()) == data
