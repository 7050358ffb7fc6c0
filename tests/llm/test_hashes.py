import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from quarry.llm import common, prob_minhash
from quarry.llm.tokens import UnitEncoder, tokenizer_path


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(n))


WORDS = [thue_morse(1 << k, f) for k in range(4, 13) for f in (0, 1)]


def test_thue_morse_words_have_hashes_of_their_own():
    raw, off = common.text_buffer(pa.array(WORDS))
    h, counts = common.words(raw, off)
    assert counts.tolist() == [1] * len(WORDS) and len(set(h.tolist())) == len(WORDS)


def test_equal_runs_agree_and_close_ones_differ():
    rng = np.random.default_rng(2)
    runs = [rng.integers(97, 100, rng.integers(1, 40)).astype(np.uint8) for _ in range(3000)]
    runs += [np.array(x, np.uint8) for x in ([97], [97, 0], [97, 0, 0], [0] * 8, [0] * 9, [0] * 16)]
    at = np.cumsum([0] + [len(r) for r in runs[:-1]])
    h = common.run_hashes(np.concatenate(runs), at)
    by = {}
    for r, x in zip(runs, h.tolist()):
        assert by.setdefault(r.tobytes(), x) == x
    assert len(set(by.values())) == len(by)


def test_token_ids_of_thue_morse_words():
    path = tokenizer_path("word_bpe_49k.json")
    flat, off = UnitEncoder(path).ids(pa.array([f"x {w}" for w in WORDS]))
    tok = Tokenizer.from_file(path)
    for i, w in enumerate(WORDS):
        assert flat[off[i]:off[i + 1]].tolist() == tok.encode(f"x {w}", add_special_tokens=False).ids


def test_documents_of_thue_morse_words_stay_apart(spark):
    docs = spark.createDataFrame(list(enumerate(f"{w} one two three four" for w in WORDS[-6:])), "doc_id long, text string")
    assert zlib.crc32(b"") == 0 and prob_minhash.drop_near_duplicates(docs).count() == 6
