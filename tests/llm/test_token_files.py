import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm import token_files
from quarry.llm.tokens import UnitEncoder, tokenizer_path
from tests.conftest import SF_SMALL

PATH = tokenizer_path("word_bpe_49k.json")


def want(rows):
    tok, out, at = Tokenizer.from_file(PATH), [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = token_files.op8_token_files(spark, SF_SMALL).collect()
    assert sorted(tuple(r) for r in got) == [w[:4] for w in want(rows)]


def test_many_shards_round_trip_and_edge_cases(spark, tmp_path):
    rows = [(None, "null id"), (5, None), (5, "b a"), (5, "b a"), (-3, "Été 日本 " * 50), (9, "x" * 30_000), (7, "")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, shard int")
    for width in (2, 4):
        folder = f"{tmp_path}/{width}"
        m = token_files.write_tokens(docs, folder, PATH, 1, width, shard_bytes=100)
        assert len(m) > 2 and [x[3] for x in m] == list(np.cumsum([0] + [x[2] for x in m[:-1]]))
        got = [tuple(r) for r in token_files.read_tokens(spark, f"file://{folder}", m, width, with_ids=True).collect()]
        assert sorted(got, key=lambda r: r[1]) == want(rows)
    m = token_files.write_tokens(docs.limit(0), f"{tmp_path}/none", PATH, 1)
    assert m == [] and token_files.read_tokens(spark, f"{tmp_path}/none", m).count() == 0


def test_only_mounted_folders():
    assert token_files.local_path("file:///a/b") == "/a/b" and token_files.local_path("/a") == "/a"
    with pytest.raises(ValueError):
        token_files.local_path("s3://x/y")


def test_rows_of_one_id_and_text_make_many_shards(spark, tmp_path):
    same = [(None, "one two three " * 5)] * 900
    rows = same + [(None, f"text {i}") for i in range(300)] + [(4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    m = token_files.write_tokens(docs, f"{tmp_path}/hot", PATH, 1, shard_bytes=4000)
    assert len(m) > 8 and max(x[1] for x in m) < 400
    got = token_files.read_tokens(spark, f"{tmp_path}/hot", m, with_ids=True).collect()
    assert sorted(tuple(r[4]) for r in got) == sorted(tuple(w[4]) for w in want(rows))
    assert sorted(r[1] for r in got) == list(np.cumsum([0] + [r[2] for r in sorted(got, key=lambda r: r[1])[:-1]]))
    assert [r[0] for r in sorted(got, key=lambda r: r[1])][-1] == 4


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_of_words_and_marks_as_in_whole_texts(name):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZé×÷ßÿÀ'’!<|>_^` \n\t.9µªº²Ａ日ñ́ -~{s t") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a<|endoftext|> b", "x's", "it'LL go", "\n\nWord..", "Straße ẞ İI ı", "ÀÉ!", " go.\nOn ÉCHEN!! du %%%"]
    enc, tok = UnitEncoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    tok.encode_special_tokens = True
    assert enc.form is not None
    flat, off = enc.ids(pa.array(texts, pa.large_string()))
    for i, x in enumerate(texts):
        assert flat[off[i]:off[i + 1]].tolist() == tok.encode(x, add_special_tokens=False).ids, x
    enc.form = None  # a file of another kind goes through the whole tokenizer
    enc.forget()
    assert enc.ids(pa.array(texts, pa.large_string()))[0].tolist() == flat.tolist()
