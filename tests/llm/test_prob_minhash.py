import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import common, prob_minhash as pm
from tests.conftest import SF_SMALL


def bag(text):
    w = (text or "").split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jp(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in keys) for d in keys if x[d] and y[d])


def exact(texts):
    own, h, w = pm.weighted(*common.text_shingles(pa.array(texts)))
    return [(h[own == i], w[own == i]) for i in range(len(texts))]


def test_similarity_and_estimate():
    rng = np.random.default_rng(5)
    for _ in range(12):
        base = [f"w{i}" for i in rng.integers(0, 30, rng.integers(1, 200))]
        other = list(base)
        for i in rng.integers(0, len(base), rng.integers(0, 12)):
            other[i] = "z"
        texts = [" ".join(base * 2), " ".join(other)]
        x, y = exact(texts)
        want = jp(bag(texts[0]), bag(texts[1]))
        assert abs(pm.similarity(*x, *y) - want) < 1e-9
        sig = pm.signatures(*pm.weighted(*common.text_shingles(pa.array(texts))), 2, 2048)
        assert abs((sig[0] == sig[1]).mean() - want) < 0.06


def test_pairs_at_the_threshold_stay_candidates():
    size, lost = pm.BANDS * pm.ROWS, 0
    least = pm.THRESHOLD - pm.MARGIN * (pm.THRESHOLD * (1 - pm.THRESHOLD) / size) ** 0.5
    for part in range(4):  # 4,000 lone pairs of Jaccard similarity 80 / 100
        h = common.mix64(np.arange(100_000, dtype=np.uint64) + np.uint64(part * 100_000)).reshape(1000, 100)
        both = np.concatenate((h[:, :90], np.concatenate((h[:, :80], h[:, 90:]), 1)))
        sig = pm.signatures(*pm.weighted(both.ravel(), np.full(2000, 90)), 2000, size)
        same = sig[:1000] == sig[1000:]
        shared = same.reshape(1000, pm.BANDS, pm.ROWS).all(axis=2).any(axis=1)
        lost += int((~shared | (same.mean(axis=1) < least)).sum())
    assert lost == 0
    # 0.8 in all: a band that is shared and an estimate that passes the second round
    low = sum(math.comb(size, k) * 0.8 ** k * 0.2 ** (size - k) for k in range(size) if k / size < least)
    assert (1 - 0.8 ** pm.ROWS) ** pm.BANDS + low < 1e-5


def classes(rows):
    reps = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        reps.setdefault(tuple((t or "").split()) or ("", d), []).append(d)
    head = {k: v[0] for k, v in reps.items()}
    parent = {d: head[k] for k, v in reps.items() for d in v}
    bags = {v: bag(" ".join(k)) if k[0] != "" else Counter() for k, v in head.items()}
    at = sorted(bags)
    index = {}
    for i in at:
        for g in bags[i]:
            index.setdefault(g, []).append(i)
    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in {(a, b) for own in index.values() for a in own for b in own if a < b}:
        if root(i) != root(j) and jp(bags[i], bags[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {d: root(d) for d in parent}


def test_query_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.class_id for r in pm.op10_minhash_near_dedup(spark, SF_SMALL).collect()}
    assert got == classes(rows)


def test_hot_group_and_chain(spark, monkeypatch):
    monkeypatch.setattr(pm, "CELL", 8)
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(60):  # a group of near copies
        own = list(base)
        own[int(rng.integers(0, 200))] = f"e{i}"
        rows.append((100 + i, " ".join(own)))
    chain = [f"c{i}" for i in range(220)]  # each like the next, the ends unlike
    rows += [(300 + k, " ".join(chain[8 * k:8 * k + 150])) for k in range(8)]
    rows += [(400 + i, " ".join(f"r{i}x{k}" for k in range(50))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in pm.near_duplicates(df).collect()}
    assert got == classes(rows)
    assert pm.drop_near_duplicates(df).count() == len(set(got.values()))


@pytest.mark.parametrize("n", [0, 1])
def test_edge_cases(spark, n):
    rows = [(None, "a b c", 1), (1, None, 2), (2, "", 3), (3, " \n ", 4), (4, "one", 5), (5, "one ", 6), (5, "two", 7),
            (6, "long " * 20_000, 8), (7, "long " * 20_001, 9)]
    df = spark.createDataFrame(rows if n else [], "doc_id long, text string, class_id int")
    got = sorted((r.doc_id, r.class_id) for r in pm.near_duplicates(df).collect())
    assert got == ([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6)] if n else [])
    kept = pm.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == ([1, 2, 3, 4, 6] if n else [])
    assert kept.where("doc_id is null").count() == n


def test_signing_holds_slices_and_short_texts_take_few_rounds(monkeypatch):
    """A worker held some 50 times 4 MB at once, and every round looked at the registers of all texts of a slice."""
    import tracemalloc

    rounds = []
    least = np.minimum.at

    class Counted:
        at = staticmethod(lambda *a: (rounds.append(1), least(*a)))
    words = [f"w{i % 977}x{i}" for i in range(60_000)]
    texts = [" ".join(words[i:i + 200]) for i in range(0, 60_000, 25)] + ["one two three"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    monkeypatch.setattr(pm.np, "minimum", Counted)
    tracemalloc.start()
    got = list(pm.sign(batch, 512))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in got) == len(texts)
    assert peak < 96 << 20, peak
    assert len(rounds) < 150 * len(got), (len(rounds), len(got))


def test_arrivals_thrown_ahead_leave_the_registers_as_they_are(monkeypatch):
    h = common.mix64(np.arange(1, 400, dtype=np.uint64))
    counts = np.array([1, 2, 3, 40, 0, 353])
    sets = pm.weighted(h, counts)
    many = pm.signatures(*sets, len(counts), 512)
    monkeypatch.setattr(pm, "AHEAD", 1)
    assert (many == pm.signatures(*sets, len(counts), 512)).all()
    assert (many[0] == many[0, 0]).all() and not many[4].any()
