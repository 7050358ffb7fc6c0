import hashlib
from collections import Counter

import corpus_pipeline as cp
from quarry.llm import common, mixing, quality
from tests.conftest import SF_SMALL
from tests.llm.test_prob_minhash import classes
from tests.llm.test_suffix_dedup import brute


def test_stages_by_brute_force(spark):
    first = docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    got = []
    for name, stage in cp.STAGES:
        docs = common.stored(stage(spark, docs, SF_SMALL), f"test-{name}")
        got.append(docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == first.columns and docs.schema == first.schema
    rows = [[tuple(r) for r in d.collect()] for d in got[:4]]
    scores = {r.doc_id: r.score for r in quality.scored(first, quality.fit(first, labels)).collect()}
    assert sorted(rows[0]) == sorted(tuple(r) for r in first.collect() if scores[r.doc_id] >= 0.3)
    group = classes([(r[0], r[1]) for r in rows[0]])
    assert sorted(rows[1]) == sorted(r for r in rows[0] if group[r[0]] == r[0])
    want = brute([(r[0], r[1]) for r in rows[1]])
    for r in rows[2]:
        old = next(x for x in rows[1] if x[0] == r[0])
        n, gone, _, digest = want[(old[0], old[1])]
        assert r[2:4] == old[2:4] and r[4] == len(r[1])
        if hashlib.sha256(r[1].encode()).hexdigest() != digest:  # a character was cut in part
            assert 0 < n - gone - len(r[1].encode()) < 12
    assert len(rows[2]) == len(rows[1])
    times = Counter(r[0] for r in rows[3])
    assert set(times) == {r[0] for r in rows[2]} and max(times.values()) <= 2
    tokens = lambda rs: Counter({k: sum(len(r[1].split()) for r in rs if r[3] == k) for k in {r[3] for r in rs}})
    before, after = tokens(rows[2]), tokens(rows[3])
    assert all(after[k] <= cp.MAX_REPEAT * before[k] + 1 for k in before)
    packed = got[4].toPandas()
    assert Counter(packed[packed.piece == 0].doc_id) == times
    for _, s in packed.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 1024 and list(s.offset) == list(s.length.cumsum() - s.length)


def test_stages_on_odd_rows(spark):
    import pytest
    rows = [(None, None, None, None, None), (1, None, "en", "s", 3), (1, "", "en", "s", 3), (2, "word " * 40_000, "en", "t", 1),
            (3, "a b c d e f g", "fr", "s", None), (3, "a b c d e f g", "fr", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for own in (rows, []):
        docs = spark.createDataFrame(own, schema)
        for name, stage in cp.STAGES:
            docs = common.stored(stage(spark, docs, SF_SMALL), f"odd-{name}")
            docs.count()
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(rows, schema))
