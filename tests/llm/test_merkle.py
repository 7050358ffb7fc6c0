import zlib
from hashlib import sha256

import pytest

from quarry.llm import merkle
from tests.conftest import SF_SMALL

UP, LOW = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tampered(row):
    d, s, la, n, t = row
    if d is None or t is None or zlib.crc32(str(d).encode()) % 3:
        return leaf(row)
    return leaf((d, s, la, n, t.encode().translate(bytes.maketrans(UP, LOW)).decode()))


def climb(nodes):
    """(root, [siblings of each leaf by level as (left, right)])"""
    own, at, paths = list(nodes), list(range(len(nodes))), [[] for _ in nodes]
    while len(own) > 1:
        runs = [own[i:i + 8] for i in range(0, len(own), 8)]
        for k, a in enumerate(at):
            run = runs[a // 8]
            paths[k].append((run[:a % 8], run[a % 8 + 1:]))
        own, at = [H(*r) for r in runs], [a // 8 for a in at]
    return own[0], paths


def expect(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    subs, info = [], {}
    for n in names:
        own = sorted(trees[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, paths = climb([leaf(r) for r in own])
        subs.append(sub)
        info[n] = (own, sub, paths)
    root, tops = climb(subs)
    out = []
    for n, top in zip(names, tops):
        own, sub, paths = info[n]
        for r, path in zip(own, paths):
            x, sibs = tampered(r), []
            for left, right in path + top:
                x = H(*left, x, *right)
                sibs += [*left, *right]
            out.append((r[0], leaf(r), sub, root, H(*sibs), x, x == root))
    return sorted(out, key=str)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = merkle.op12_merkle_manifest(spark, SF_SMALL)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == expect(rows)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [
    [(i, "s", None if i % 9 == 0 else f"l{i % 11}", i, f"Text {i}") for i in range(300)],  # ten trees and the null one: two top levels
    [(i, None, "en", None, None if i % 4 else "A") for i in range(9)] + [(None, "s", "en", 1, "B")] * 3 + [(3, "s", "en", 1, "C")] * 2,
    [(3, "s", "en", 1, "ABC é" * 3000)],
    [(1, "s", None, 1, "Ab"), (2, "s", "", 1, "aB")],
    [],
], ids=["trees", "ties", "one", "null and empty", "none"])
def test_trees_ties_and_nulls(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    df.selectExpr("*", "1 AS leaf", "'x' AS up_tree", "2 AS id").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == (expect(rows) if rows else [])


def test_row_limit_is_put_back(spark):
    was = spark.conf.get(merkle._ROW_LIMIT)
    with merkle.recursion_rows(spark):
        assert spark.conf.get(merkle._ROW_LIMIT) == "-1"
    assert spark.conf.get(merkle._ROW_LIMIT) == was
