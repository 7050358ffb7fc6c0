import zlib

import numpy as np
import pyarrow as pa

from quarry.llm import quality
from tests.conftest import SF_MID


def test_convolution_by_brute_force():
    model = quality.new_model(1)
    texts = [b"", b"a", b"xyz" * 200, bytes(range(1, 128)) * 5]
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    values, n = quality.blocks(np.frombuffer(b"".join(texts), np.uint8), off)
    p, _, _, pooled, (_, _, m, _) = quality.forward(model, quality.convolve(model["table"], values)[0], n)
    at = 0
    for t, chunks in zip(texts, m, strict=True):
        v = [*t, *[quality.PAD] * (-(-(len(t) + 5) // quality.BLOCK) * quality.BLOCK - len(t) + quality.WIDTH)]
        r = np.array([sum(model["table"][k][v[i + k]] for k in range(quality.WIDTH)) for i in range(len(v) - quality.WIDTH)])
        b = r.reshape(-1, quality.BLOCK, quality.FILTERS).max(axis=1)
        want = [np.maximum(b[i], b[i + 1]) for i in range(len(b) - 1)] or [b[0]]
        assert len(want) == chunks
        np.testing.assert_allclose(pooled[at:at + chunks], want, atol=1e-5)
        at += chunks
    assert ((p > 0) & (p < 1)).all()


def test_gradients_by_differences():
    model = {k: v.astype(np.float64) for k, v in quality.new_model(2).items()}
    raw = np.frombuffer(b"hello world " * 60 + b"other text", np.uint8)
    off, y = np.array([0, 700, len(raw)]), np.array([1.0, 0.0])

    def loss(m):
        values, n = quality.blocks(raw, off)
        p = quality.forward(m, quality.convolve(m["table"].astype(np.float32), values)[0], n)[0]
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
    g = quality.gradients({k: v.astype(np.float32) for k, v in model.items()}, raw, off, y)
    for k, at in (("w2", (3,)), ("w1", (5, 2)), ("b1", (1,)), ("table", (2, ord("o"), 7)), ("table", (0, ord("l"), 3))):
        up, down = ({**model, k: model[k].copy()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert abs((loss(up) - loss(down)) / 2e-2 - g[k][at]) < 5e-3


def test_query_accuracy_and_folds(spark):
    got = quality.op9_quality_classifier(spark, SF_MID).toPandas()
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.itertuples())
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").toPandas()
    held = got.merge(labels, on="doc_id")
    held = held[held.held_out]
    assert (held.predicted == held.quality).mean() > 0.9
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_edge_cases(spark):
    rows = [(1, None, 1.0), (1, "", 2.0), (None, "x " * 40_000, 3.0), (2, "same", 4.0), (2, "same", 4.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score double")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    got = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5} and [r._score for r in got] == [r[2] for r in rows]
    assert quality.keep_quality(docs, labels).columns == docs.columns
    assert quality.scored(docs.limit(0), quality.new_model()).count() == 0
    assert quality.fit(docs.limit(0), labels.limit(0))["w2"].sum() == 0


def test_training_is_deterministic():
    texts, y = [b"good words here " * 9, b"BAD!! " * 30] * 8, np.array([1, 0] * 8, np.float32)
    a, b = quality.train(texts, y, 3), quality.train(texts, y, 3)
    assert all((a[k] == b[k]).all() for k in a)
    s = quality.score_batch(a, pa.array(["good words here good words", "BAD!! BAD!! BAD!!"]))
    assert s[0] > s[1]
