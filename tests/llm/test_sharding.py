import hashlib
import heapq
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import sharding
from tests.conftest import SF_SMALL


def heap_loads(sizes, shards):
    heap = [(0, k) for k in range(shards)]
    counts = {}
    for s in sorted(sizes, reverse=True):
        x, k = heapq.heappop(heap)
        counts[s, k] = counts.get((s, k), 0) + 1
        heapq.heappush(heap, (x + s, k))
    return dict((k, x) for x, k in heap), counts


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 300)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(1, 7))
def test_bulk_placement_equals_one_heap_step_per_group(classes, shards):
    loads, got = [0] * shards, {}
    for s, n in sorted(classes, reverse=True):
        for k, c in enumerate(sharding.place(loads, s, n)):
            if c:
                got[s, k] = c
    want, counts = heap_loads([s for s, n in classes for _ in range(n)], shards)
    assert got == counts and loads == [want[k] for k in range(shards)]


def check(rows, got, shards=24):
    """rows: (doc_id, text); got: dicts of the query's columns."""
    size = lambda t: len((t or "").encode()) + 8
    assert sorted((str(d), size(t), zlib.crc32((t or "").encode())) for d, t in rows) == sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got)
    groups = {}
    for _, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + size(t)
    want, _ = heap_loads(groups.values(), shards)
    load, seen = dict.fromkeys(range(shards), 0), {}
    for r in got:
        load[r["shard"]] += r["size"]
        seen.setdefault(r["shard"], []).append(r)
    assert load == want
    for own in seen.values():
        own.sort(key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert [r["doc_id"] for r in own] == sorted((r["doc_id"] for r in own), key=lambda d: (d is not None, d))


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = [r.asDict() for r in sharding.op11_lpt_sharding(spark, SF_SMALL).collect()]
    check(rows, got)
    text = dict(rows)
    shards = {}
    for r in got:
        shards.setdefault(text[r["doc_id"]] or "", set()).add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in shards.values())


def test_hot_group_ties_nulls_clashes_and_no_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "copy") for i in range(200)] + [(None, None), (None, ""), (7, "x"), (7, "x"), (7, "x" * 50_000)]
    rows += [(1000 + i, "w" * rng.randint(1, 9) + hashlib.md5(str(i).encode()).hexdigest()) for i in range(300)]
    docs = spark.createDataFrame([(d, t, "k", 5, 5) for d, t in rows], "doc_id long, text string, key string, slot int, tie int").repartition(4)
    got = sharding.shard_documents(docs, 5)
    assert got.columns == ["doc_id", "text", "key", "tie", "shard", "slot"]
    out = [r.asDict() | {"size": len((r["text"] or "").encode()) + 8, "text_crc32": zlib.crc32((r["text"] or "").encode())} for r in got.collect()]
    check(rows, out, 5)
    assert {r["key"] for r in out} == {"k"} and {r["tie"] for r in out} == {5}
    assert len({r["shard"] for r in out if r["text"] == "copy"}) == 1
    sharding.write_shards(got, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == len(rows) and back.where("shard = 0").count() == sum(r["shard"] == 0 for r in out)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_same_result_whatever_the_partitions(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    a = sharding.shard_documents(docs, 6).select("doc_id", "shard", "slot")
    b = sharding.shard_documents(docs.repartition(7, F.xxhash64("text")), 6).select("doc_id", "shard", "slot")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
