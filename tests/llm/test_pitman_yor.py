import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import pitman_yor as py
from tests.conftest import SF_SMALL


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0d]+", low) + [None]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1


def reference(rows):
    c = Counter(t for d, x in rows if not held(d) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    return {(d, x): (held(d), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n,
                     sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))) for d, x in rows}


def test_squeeze():
    a = [np.arange(5), np.zeros(0, np.uint8), np.array([1.5, -2], np.float32)]
    assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(a, py.unsqueezed(py.squeezed(a)), strict=True))


def exact_tables(c, d, theta, p):
    """Mean tables of c customers of one word alone in a restaurant: by the recursion over customers, in plain floats."""
    w = {1: theta * p}
    for n in range(1, c):
        grown = Counter()
        for t, x in w.items():
            grown[t] += x * (n - d * t)
            grown[t + 1] += x * (theta + d * t) * p
        top = max(grown.values())
        w = {t: x / top for t, x in grown.items() if x > top * 1e-18}
    return sum(t * x for t, x in w.items()) / sum(w.values())


@pytest.mark.parametrize("c", [2, 3, 10, 64, 65, 500])
@pytest.mark.parametrize("p", [0.01, 0.2, 0.9])
def test_seating_against_exact_posterior(c, p):
    """At the production rounds, sizes on both sides of every table width."""
    rows = 4000  # as many restaurants
    mean, last = py.seat(np.full(rows, c), np.arange(rows), np.full(rows, p), py.D2, py.THETA2, np.ones(rows), 3)
    exact = exact_tables(c, py.D2, py.THETA2, p)
    assert abs(mean.mean() - exact) < 0.02 * exact and last.min() >= 1 and last.max() <= c


def test_two_words_of_a_restaurant():
    """Sections that share a restaurant: the joint distribution by enumeration of both numbers of tables."""
    d, theta, c, p, rows = 0.6, 1.0, (3, 6), (0.4, 0.3), 4000
    s = {n: np.exp(py.seatings(d, np.array([n]), n))[0] for n in c}
    joint = np.array([[s[c[0]][a - 1] * s[c[1]][b - 1] * p[0] ** a * p[1] ** b * math.prod(theta + d * j for j in range(a + b))
                       for b in range(1, c[1] + 1)] for a in range(1, c[0] + 1)])
    joint /= joint.sum()
    want = (joint.sum(axis=1) @ np.arange(1, 4), joint.sum(axis=0) @ np.arange(1, 7))
    mean, _ = py.seat(np.tile(c, rows), np.repeat(np.arange(rows), 2), np.tile(p, rows), d, theta, np.ones(rows), 7)
    assert np.allclose((mean[::2].mean(), mean[1::2].mean()), want, rtol=0.02)


def test_scaled_sections(monkeypatch):
    """Sections beyond the tabulated customers have nearly the weights of the recursion."""
    for d in (py.D1, py.D2):
        exact = py.seatings(d, np.array([3000]), 400)[0]
        with monkeypatch.context() as m:
            m.setattr(py, "EXACT", 1500)
            scaled = py.seatings(d, np.array([3000]), 400)[0]
        assert np.abs(np.diff(exact) - np.diff(scaled)).max() < 0.01


def test_scores_do_not_depend_on_the_session(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted((r.doc_id, r.score) for r in py.score(docs.repartition(int(n))).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [x[0] for x in got[0]] == [x[0] for x in got[1]]
    assert np.allclose([x[1] for x in got[0]], [x[1] for x in got[1]], rtol=1e-6)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = reference(rows)
    got = py.op3_lm_scoring(spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        w = want[(r.doc_id, text[r.doc_id])]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert abs(r.base_score - w[4]) < 1e-6 * max(1, abs(w[4]))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # better than the unigram on unseen texts
    inside = [r for r in got if not r.held_out]
    assert sum(r.score for r in inside) > 0.8 * sum(r.base_score for r in inside)


@pytest.mark.parametrize("frequent", [1000, 4])
def test_probabilities_sum_to_one(spark, monkeypatch, frequent):
    """From the scores of all texts of none, one and two words: with x_t = p(t | begin) and
    e_t = p(end | t), the score of t is S_t = x_t e_t and of t s is S_ts = x_t p(s | t) e_s, so
    sum_s x_s S_ts / S_s = x_t - S_t. Its solution and p(end | begin) add up to one. ``never``
    stands for the unknown type; ``frequent`` 4 deals frequent contexts by pairs."""
    monkeypatch.setattr(py, "FREQUENT", frequent)
    monkeypatch.setattr(py, "CHUNK_BYTES", 300)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(8)]
    train = [i for i in range(2000) if not held(i)][:60]
    rows = [(i, " ".join(rng.choice(vocabulary, 12) if k % 3 else ["w0"] * 6)) for k, i in enumerate(train)]
    test = iter([i for i in range(5000, 9000) if held(i)])
    types = [*vocabulary, "never"]
    texts = ["", *types, *[f"{t} {s}" for t in types for s in types]]
    ids = {t: next(test) for t in texts}
    rows += [(i, t) for t, i in ids.items()]
    got = {r.doc_id: 10 ** r.score for r in py.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = np.array([got[ids[t]] for t in types])
    two = np.array([[got[ids[f"{t} {s}"]] for s in types] for t in types])
    x = np.linalg.solve(np.eye(len(types)) - two / one[None, :], one)
    assert abs(x.sum() + got[ids[""]] - 1) < 1e-4 and (x > 0).all()


def test_edge_cases(spark):
    rows = [(None, "a b"), (None, None), (1, ""), (3, "A a\tB b"), (3, "A a\tB b"), (4, "a b " * 30_000), (7, "zz")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = py.score(df).collect()
    want = reference(list(rows))
    n = sum(len(tokens(x)) for d, x in rows if not held(d))
    assert len(got) == len(rows) and all(r.train_tokens == n and r.score < 0 for r in got)
    sizes = sorted((r.n_tokens, r.held_out) for r in got)
    assert sizes == sorted((want[r][1], want[r][0]) for r in rows)
    assert py.score(df.limit(0)).count() == 0
    only = [i for i in range(100) if held(i)][0]
    one = py.score(spark.createDataFrame([(only, "no training here")], "doc_id long, text string")).collect()
    assert one[0].train_tokens == 0 and one[0].n_known == 0
