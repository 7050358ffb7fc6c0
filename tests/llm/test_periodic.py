import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import periodic
from tests.conftest import SF_SMALL


def brute(w):
    """Every run of a list of words: maximal stretches for each period, the smallest period of each stretch."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(6, 4 * q):
                best.setdefault((i, size), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def expect(doc, text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(w)
    if doc is not None and (h := zlib.crc32(str(doc).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    got = brute(w)
    gone = {i for s, n, q in got for i in range(s + q, s + n)}
    top = None
    for s, n, q in got:
        if top is None or n * top[2] > top[1] * q:
            top = (s, n, q)
    return (doc, len(got), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in got).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 12)), max_size=5).map(
    lambda ps: [x for p, k in ps for x in p * k])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=4))
def test_runs_equal_brute_force(docs):
    w = np.array([x for d in docs for x in d], np.int64)
    got = periodic.runs(w, np.array([len(d) for d in docs]))
    assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, d in enumerate(docs) for r in brute(d)]


def test_cover_index_equals_comparison():
    rng = np.random.default_rng(5)
    for n, letters in ((30, 1), (400, 2), (700, 3)):
        w = rng.integers(0, letters, n)
        w[n // 2:] = w[:n - n // 2]
        w = np.append(w, letters)  # ends once
        i, j = (x.ravel() for x in np.triu_indices(n, 1))
        want = periodic.matching(np.append(w, -1), i, j, n)
        far = want >= 12
        assert (periodic.CoverIndex(w).extension(i[far], j[far]) == want[far]).all() and far.any()


def test_many_pairs_are_taken_in_pieces(monkeypatch):
    w = np.tile([0, 1, 0, 2, 1], 200)
    want = periodic.runs(w, np.array([600, 400]))
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert (periodic.runs(w, np.array([600, 400])) == want).all() and len(want) == 2


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = periodic.op13_periodic_runs(spark, SF_SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(expect(d, t) for d, t in rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_edge_cases_and_real_outputs(spark):
    long = " ".join(f"w{i % 7}" for i in range(30_000)) + " " + "z " * 5000
    rows = [(None, "a b " * 8), (None, None), (1, ""), (1, "  \t\n\v\f\r "), (2, "é é " * 9), (2, "é é " * 9), (3, "a" * 100_000), (4, "x x x x x"), (5, "x x x x x x")]
    docs = spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, n_runs int, collapsed string")
    got = periodic.periodic_runs(docs).drop("runs", "collapsed")
    key = lambda r: str(r)
    plain = [expect(None, t)[1:] for _, t in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((d, *p) for (d, _), p in zip(rows, plain)), key=key)
    one = periodic.periodic_runs(spark.createDataFrame([(9, long)], "doc_id long, text string")).first()
    assert [list(r) for r in one["runs"]] == [[0, 30_000, 7], [30_000, 5000, 1]]
    assert one["collapsed"] == "w0 w1 w2 w3 w4 w5 w6 z"
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
