"""Operator 1: one-permutation MinHash fingerprints with optimal densification.

Each shingle is hashed once; its high bits choose one of ``bins`` bins and the bin keeps its
least hash. An empty bin takes the value of the first filled bin in its own fixed random
order (optimal densification: the order is the bin's, not the text's). The low ``bits`` bits
of every bin are packed; likeness is the share of equal bins, corrected for chance agreement
of the low bits: (m - 2^-bits) / (1 - 2^-bits), held to 0..1.

Edge cases: a text without words has the empty fingerprint, alike (1.0) only to another such;
a null text is empty; equal texts have equal fingerprints; repeated rows and repeated ids are
kept, ordered by id (descending, null last) and then text; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

BINS, BITS = 512, 4
#: Text bytes that one task edits and fingerprints together.
PART_BYTES = 12 << 20
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_NO_ID = -(1 << 63)


def probe_order(bins: int) -> np.ndarray:
    """Each bin's own random order of all bins (a permutation per row, from hashes)."""
    i = np.arange(bins, dtype=np.uint64)
    return np.argsort(common.mix64(i[:, None] * np.uint64(bins) + i[None, :] + np.uint64(1 << 40)), axis=1)


def fingerprints(h: np.ndarray, counts: np.ndarray, bins: int = BINS, bits: int = BITS,
                 order: np.ndarray | None = None) -> np.ndarray:
    """(texts, bins) low-order values from shingle hashes laid end to end; a text without
    shingles has the value 255 throughout."""
    n, shift = len(counts), np.uint64(64 - int(bins).bit_length() + 1)
    low = np.full(n * bins, _EMPTY)
    np.minimum.at(low, common.owners(counts) * bins + (h >> shift).astype(np.int64), h)
    low = low.reshape(n, bins)
    full = low != _EMPTY
    order = probe_order(bins) if order is None else order
    some = full.any(axis=1)
    row, col = np.nonzero(~full & some[:, None])
    for k in range(24):
        if not len(row):
            break
        donor = order[col, k]
        hit = full[row, donor]
        low[row[hit], col[hit]] = low[row[hit], donor[hit]]
        row, col = row[~hit], col[~hit]
    if len(row):  # texts of few shingles: the first filled bin of the order, at once
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(bins)[None, :].repeat(bins, 0), axis=1)
        for r in np.unique(row):
            own, filled = col[row == r], np.flatnonzero(full[r])
            low[r, own] = low[r, filled[np.argmin(rank[np.ix_(own, filled)], axis=1)]]
    out = (low & np.uint64((1 << bits) - 1)).astype(np.uint8)
    out[~some] = 255
    return out


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bias-corrected likeness of rows of two fingerprint arrays."""
    chance = 2.0 ** -bits
    got = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where((a[:, 0] == 255) | (b[:, 0] == 255), (a[:, 0] == b[:, 0]).astype(float), got)


def packed_hex(f: np.ndarray, bits: int = BITS) -> list[str]:
    """Each row packed, ``8 // bits`` values a byte, as hexadecimal text ('' if empty)."""
    per = 8 // bits
    out = np.zeros((len(f), f.shape[1] // per), np.uint8)
    for k in range(per):
        out |= (f[:, k::per] & ((1 << bits) - 1)) << np.uint8(bits * k)
    return [row.tobytes().hex() if one != 255 else "" for row, one in zip(out, f[:, 0], strict=True)]


def fingerprint_texts(texts: list[str], bins: int = BINS, bits: int = BITS, order=None) -> np.ndarray:
    """Fingerprints of a list of texts, a bounded slice at a time."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    got = [fingerprints(*common.text_shingles(s.column("text")), bins, bits, order)
           for s in common.slices(batch, rows=2048)]
    return np.concatenate(got) if got else np.zeros((0, bins), np.uint8)


def with_next(docs: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """Deal ``doc_id, text`` into id ranges (column ``part``) so that each part also holds,
    marked ``extra``, the document after its last one in descending id order. Only the ids at
    range ends, one a part, pass through the driver."""
    key = F.coalesce(F.col("doc_id"), F.lit(_NO_ID))
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ids = docs.select("doc_id")
    bounds = common.range_bounds(ids, key, max(1, -(-total // part_bytes)))
    part = common.part_of(key, bounds)
    heads = sorted((r["part"], r["head"]) for r in
                   ids.groupBy(part.alias("part")).agg(F.max(key).alias("head")).collect())
    # The first document of a part follows the last one of the next higher part; the first of
    # all follows the last of all.
    goes = {head: heads[(i + 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}
    copies = F.array(F.struct(part.alias("part"), F.lit(False).alias("extra")))
    if goes:
        to = F.create_map(*[F.lit(x) for pair in goes.items() for x in pair])
        copies = F.when(key.isin(list(goes)), F.array(F.struct(part.alias("part"), F.lit(False).alias("extra")),
                                                      F.struct(to[key].alias("part"), F.lit(True).alias("extra")))
                        ).otherwise(copies)
    dealt = docs.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.part", "c.extra")
    return dealt, max(1, len(heads))


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def edited_fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the
    beginning of the next document in descending id order; the first follows the last)."""
    dealt, _ = with_next(docs)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in (
        "edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(t: pa.Table) -> pa.Table:
        doc, text, extra = (t.column(c).to_pylist() for c in ("doc_id", "text", "extra"))
        at = sorted((i for i in range(len(doc)) if not extra[i]),
                    key=lambda i: (doc[i] is None, -(doc[i] or 0), text[i]))
        last = min((i for i in range(len(doc)) if extra[i]), default=at[0] if at else None, key=lambda i: text[i])
        if not at:
            return kinds.empty_table()
        own = [text[i] for i in at]
        after = own[1:] + [text[last]]
        edited = [a[:len(a) - len(a) // 3] + b[:len(a) // 3] for a, b in zip(own, after, strict=True)]
        order = probe_order(bins)
        f = fingerprint_texts([*own, text[last]], bins, bits, order)
        e = fingerprint_texts(edited, bins, bits, order)
        return pa.table([[doc[i] for i in at], [len(x) for x in own],
                         [hashlib.sha256(x.encode()).hexdigest() for x in edited], packed_hex(f[:-1], bits),
                         packed_hex(e, bits), likeness(f[:-1], e, bits), likeness(f[:-1], f[1:], bits)], schema=kinds)

    return dealt.groupBy("part").applyInArrow(run, OUT)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.table(spark, sf_dir, "documents"))
