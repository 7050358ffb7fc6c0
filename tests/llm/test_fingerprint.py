import hashlib

import numpy as np
import pyarrow as pa

from quarry.llm import common, fingerprint
from tests.conftest import SF_SMALL


def shingle_set(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_words_and_shingles_match_python():
    texts = ["", None, "a", " a b\tc  d\n", "a b c d e f", "x" * 300 + " é ñ", "a b c d e f"]
    h, n = common.text_shingles(pa.array(texts))
    assert list(n) == [0, 0, 1, 1, 2, 1, 2]
    own = np.split(h, np.cumsum(n)[:-1])
    assert (own[4] == own[6]).all() and len(set(h)) == 5


def test_likeness_follows_jaccard():
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 5000, 900)]
    errors = []
    for cut in range(0, 900, 60):
        other = base[:cut] + [f"v{i}" for i in rng.integers(0, 5000, 900 - cut)]
        a, b = " ".join(base), " ".join(other)
        f = fingerprint.fingerprint_texts([a, b])
        errors.append(fingerprint.likeness(f[:1], f[1:])[0] - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.1


def test_densified_short_texts():
    f = fingerprint.fingerprint_texts(["a b c d e f", "a b c d e g", "", "one", "one"])
    got = fingerprint.likeness(f[[0, 2, 2, 3]], f[[1, 2, 0, 4]])
    assert 0.2 < got[0] < 0.45 and list(got[1:]) == [1.0, 0.0, 1.0]  # jaccard 1/3


def check(rows, got):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    text = [r[1] or "" for r in rows]
    want = []
    for i, (doc, _) in enumerate(rows):
        a, b = text[i], text[(i + 1) % len(rows)]
        k = len(a) // 3
        want.append((doc, len(a), hashlib.sha256((a[:len(a) - k] + b[:k]).encode()).hexdigest()))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str)


def test_query_and_parts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = fingerprint.op1_document_fingerprints(spark, SF_SMALL).collect()
    check(rows, got)
    by = {r.doc_id: r for r in got}
    order = sorted(by, reverse=True)
    text = dict(rows)
    err = [by[a].near_next - jaccard(text[a], text[b]) for a, b in zip(order, order[1:], strict=False)]
    assert np.abs(err).max() < 0.12
    same = {}
    for d, t in rows:
        assert same.setdefault(t, by[d].fingerprint) == by[d].fingerprint
    dealt, n = fingerprint.with_next(docs, 20_000)
    assert n > 5 and dealt.where("extra").count() == n


def test_edge_cases(spark, monkeypatch):
    rows = [(None, "n " * 20), (3, None), (3, ""), (7, "é" * 10), (7, "é" * 10), (9, "a b c"), (-4, "x y z " * 400)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
    assert {len(x.fingerprint) for x in fingerprint.edited_fingerprints(docs).collect()} == {0, 512}
    check(rows, fingerprint.edited_fingerprints(docs).collect())
    assert fingerprint.edited_fingerprints(docs.limit(0)).count() == 0
    check(rows[:1], fingerprint.edited_fingerprints(docs.where("doc_id is null")).collect())
