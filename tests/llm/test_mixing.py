import math

import pytest

from quarry.llm import mixing
from tests.conftest import SF_MID, SF_SMALL
from tools.compare import compare


def make(spark, sizes, words=5):
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k, " ".join(["w"] * words), s))
            k += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_oracle(spark):
    for sf in (SF_SMALL, SF_MID):
        r = compare(spark, sf, ["op5_temperature_mixing"], verbose=False)["op5_temperature_mixing"]
        assert r["match"], r


def test_repetition_limit_and_shares(spark):
    docs = make(spark, {"hot": 2000, "b": 300, None: 200})
    got = mixing.mix(docs, max_repeat=1.5).toPandas()
    n = got.source.fillna("none").value_counts()
    shares = [2000 / 2500, 300 / 2500, 200 / 2500]
    lo, hi = 0.0, 1.0
    for _ in range(60):
        a = (lo + hi) / 2
        z = sum(s ** a for s in shares)
        lo, hi = (a, hi) if max(s ** a / z / s for s in shares) > 1.5 else (lo, a)
    for key, s in zip(("hot", "b", "none"), shares, strict=True):
        assert abs(n[key] - s ** a / z * 2500) <= 2
    assert n["none"] == 300  # the rarest source meets the limit
    counts = got.groupby("doc_id").size()
    assert counts.max() == 2 and len(got) <= 2500
    full = got[(got.source == "b") & (got._block == 0)]
    assert full.doc_id.nunique() == 300  # a full block is a permutation of all rows
    assert list(full.sort_values("_place").doc_id) != sorted(full.doc_id)


def test_entropy_target(spark):
    docs = make(spark, {"a": 1000, "b": 100, "c": 50})
    for want in (0.3, 0.6, 1.0):
        p = mixing.plan(docs.select("source", "doc_id", mixing.n_words(docs.text).alias("tokens")), 0, entropy=want).collect()
        assert abs(-sum(r.weight * math.log(r.weight) for r in p) - want) < 1e-9


def test_cover_keeps_every_row(spark):
    docs = make(spark, {"a": 900, "b": 90, "c": 30})
    got = mixing.mix(docs, max_repeat=1.25, cover=True).groupBy("doc_id").count().toPandas()
    assert len(got) == 1020 and got["count"].max() == 2
    assert mixing.mix(docs, max_repeat=1.25, budget_tokens=500).selectExpr(
        "sum(size(split(text, ' ')))").first()[0] in range(480, 501)


def test_cover_of_sources_beyond_2_33_words(spark):
    totals = spark.createDataFrame([("a", 1 << 50), ("b", (1 << 53) + 1)], "source string, tokens long")
    assert mixing.weights(totals, max_repeat=1.25, cover=True).where("quota < tokens").count() == 0


def test_equal_totals_count_as_often_as_they_occur(spark):
    totals = spark.createDataFrame([(str(i), 100 if i < 8 else 700) for i in range(10)], "source string, tokens long")
    got = mixing.weights(totals, max_repeat=2.0).toPandas()
    assert abs(got.weight.sum() - 1) < 1e-9 and abs((got.weight * 2200 / got.tokens).max() - 2) < 1e-6
    assert abs(got.weight[0] - 200 / 2200) < 1e-6


def test_edge_cases(spark):
    rows = [(None, None, "s", 1), (1, "", "s", 2), (2, "a b", None, 3), (2, "a b", None, 4), (3, "x " * 50_000, "t", 5),
            (4, " ", "empty", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int")
    got = mixing.mix(docs, max_repeat=2.0, cover=True)
    assert set(docs.columns) < set(got.columns)
    ids = [r.tokens for r in got.collect()]
    assert set(ids) == {1, 2, 3, 4, 5, 6}
    assert ids.count(3) == ids.count(4) == 2 and ids.count(5) == 1
    assert mixing.mix(docs.limit(0), max_repeat=2.0).count() == 0
    with pytest.raises(ValueError):
        mixing.weights(docs, entropy=1.0, max_repeat=2.0)


def test_no_python_in_the_plan(spark):
    text = mixing.op5_temperature_mixing(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "InPandas" not in text
