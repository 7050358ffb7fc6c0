import numpy as np
import pytest

from quarry.llm import projections as pj
from tests.conftest import SF_MID, SF_SMALL


def brute(rows, threshold=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = [i for i, _ in ok], np.array([v / np.linalg.norm(v) for _, v in ok])
    s = x @ x.T >= threshold - 1e-12
    out = {i: (0, i) for i, _ in rows}
    comp = np.array(ids)
    for _ in range(len(ids)):
        new = np.array([comp[s[k]].min() for k in range(len(ids))])
        if (new == comp).all():
            break
        comp = new
    for k, i in enumerate(ids):
        out[i] = (int(s[k].sum()) - 1, int(comp[k]))
    return out


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_query_by_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = pj.op4_collision_projections(spark, sf).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_calibrated_recall():
    d = pj.directions(64, 1024)
    hits, recall = pj.calibrate(d, 0.95, pj.KEEP, 0.995)
    assert hits >= 1 and recall >= 0.995
    assert pj.calibrate(d, 0.95, pj.KEEP, 0.9)[0] >= hits


def test_hot_groups_in_cells(spark, monkeypatch):
    monkeypatch.setattr(pj, "CELL", 16)
    rng = np.random.default_rng(2)
    base = rng.standard_normal(32)
    rows = [(i, (base * 2).tolist()) for i in range(50)]
    rows += [(100 + i, (base + 0.06 * rng.standard_normal(32)).tolist()) for i in range(80)]
    rows += [(300 + i, rng.standard_normal(32).tolist()) for i in range(200)]
    got = pj.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)


def test_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, nan]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [2.0, 0.0]),
            (8, [0.0, 1.0]), (9, [1.0, 0.0, 0.0]), (6, [1.0, 0.0]), (10, []), (11, [1e300, 1e300]), (12, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(None, [1.0, 0.0], 0)], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pj.near_vectors(df).collect()}
    assert got[6] == (2, 6, True) and got[7] == (2, 6, False) and got[12] == (2, 6, False)
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 8, 9, 10, 11)) and len(got) == 12
    assert pj.near_vectors(df.limit(0)).count() == 0


def test_few_dimensions_and_mixed_lengths(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for dims, start, n in ((1, 0, 6), (2, 100, 130), (3, 1000, 200), (16, 2000, 150)):
        own = [(start + i, rng.standard_normal(dims).tolist()) for i in range(n)]
        own += [(start + n + i, own[0][1]) for i in range(5)]  # equal vectors
        own += [(start + n + 5 + i, (np.array(own[1][1]) * (1 + 0.02 * rng.standard_normal(dims))).tolist()) for i in range(20)]
        rows += own
        want |= brute(own)
    got = pj.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_projections_kept_until_the_recall_is_reached():
    m, keep, hits = pj.settings_for(1000, 2, 0.95, pj.KEEP, 0.995)
    assert keep > pj.KEEP and hits >= 1 and pj.calibrate(pj.directions(2, m), 0.95, keep, 0.995)[1] >= 0.995
    assert pj.settings_for(5_000, 64, 0.95, pj.KEEP, 0.995)[1] == pj.KEEP
