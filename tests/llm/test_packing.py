import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing
from quarry.llm.tokens import UnitEncoder, tokenizer_path
from tests.conftest import SF_SMALL

PATH = tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_same_ids_as_whole_texts(name):
    enc = UnitEncoder(tokenizer_path(name))

    @given(st.lists(st.text(alphabet="ab' \n\t\x0b\x1c\x85\u00a0\u3000e\u0301\u00e9\u03a3\u03c31\u0663!-\u200b\u65e5<|endoftext|>\r", max_size=40),
                    max_size=8))
    @settings(max_examples=300, deadline=None)
    def check(texts):
        flat, off = enc.ids(pa.array(texts, pa.string()))
        want = [e.ids for e in enc.plain.encode_batch(texts, add_special_tokens=False)]
        assert [flat[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == want
    check()


def test_units_of_real_texts(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()] + [None, "", "a <|endoftext|> b"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc = UnitEncoder(tokenizer_path(name))
        flat, off = enc.ids(pa.array(texts))
        want = [e.ids for e in enc.plain.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [flat[a:b].tolist() for a, b in zip(off, off[1:], strict=False)] == want


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)]
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


def test_capacities_hold_and_rules_differ():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 70, 500)
    for rule in ("norm", "dot"):
        place, offset, used = packing.best_fit(n, 100, 3, 6000, (1.0, 1.0, 1.0), rule)
        for s in range(used):
            own = np.flatnonzero(place == s)
            assert len(own) <= 3 and n[own].sum() <= 100 and (n[own] ** 2).sum() <= 6000
            own = own[np.argsort(offset[own])]
            assert (offset[own] == np.cumsum(n[own]) - n[own]).all()


def test_query(spark):
    got = packing.op2_best_fit_packing(spark, SF_SMALL).toPandas()
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").toPandas()
    tok = Tokenizer.from_file(PATH)
    total = 0
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        own = got[got.doc_id == doc].sort_values("piece")
        assert own.length.sum() == len(ids) and list(own.piece) == list(range(len(own)))
        for r in own.itertuples():
            assert zlib.crc32(np.asarray(ids[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        total += len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == list(s.length.cumsum() - s.length) and s.length.sum() <= 1024
    assert got.sequence_id.nunique() <= -(-total // 1024) + 1


def test_edge_cases(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a b", "z"), (2, "word " * 3000, "s"), (2, "word " * 3000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(docs, PATH, 64, with_ids=True).toPandas()
    assert (got[got.doc_id == 1].length == 1).all() and len(got[got.doc_id == 1]) == 2
    assert got.length.max() == 64 and all(len(r.ids) == r.length for r in got.itertuples())
    assert (got.groupby("sequence_id").length.sum() <= 64).all()
    assert packing.pack_documents(docs.limit(0), PATH, 64).count() == 0


def test_equal_rows_use_every_shard(spark):
    pieces = spark.range(0, 2000, 1, 4).selectExpr("7L AS doc_id", "100L AS length")
    got = packing.pack(pieces, 1024, shards=8).collect()
    assert len(got) == 2000 and len({r.sequence_id >> 32 for r in got}) == 8
