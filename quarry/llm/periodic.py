"""Operator 13: periodic runs of words, by longest common extensions over a difference cover.

A run is a maximal stretch of words with smallest period q and at least max(6, 4q) words.

* Longest common extension (LCE): of all suffixes only those at positions whose residue modulo 13
  lies in the difference cover {0, 1, 3, 9} are sorted: by their first 13 words, then by doubling
  (a sample plus 13 * 2^k is a sample). Any two positions have a shift below 13 that takes both to
  samples, so a query compares at most 12 words one by one and then takes the minimum of the neighbours' common
  prefixes between two ranks from a sparse table.
* Grid: two words q apart are equal all along a run of period q, over at least max(6, 4q) - q places, so one of
  the places 0, s, 2s, ... with that step s lies in it. All (place, q) of a document are n ln n; where
  the two words are equal the extensions to the right and, on the reversed words, to the left give the whole
  stretch. A stretch found with several periods belongs to the smallest.

All documents of an Arrow slice are worked on at once as one array of integers: words become numbers by a
dictionary of their bytes (exact), apart for each document, with a number of its own between two documents, so nothing
matches across them. Only documents with a pair that the word by word comparison leaves open are indexed. The scan is narrow: a
document is read by one task, nothing is shuffled.

Edge cases: a null or empty text has no words, no runs and the digests of the empty text; a null id has no rewritten
words; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common

#: A perfect difference set, all of 1..12 are differences of its members modulo 13.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Least words of a run, and least number of its periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: (place, period) pairs looked at together.
PAIRS = 1 << 21
_SLOT = np.full(MODULUS, -1)
_SLOT[list(COVER)] = np.arange(len(COVER))


def _shifts() -> np.ndarray:
    """Least shift that takes residues (a, b) both into the cover."""
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(d for d in range(MODULUS) if _SLOT[(a + d) % MODULUS] >= 0 and _SLOT[(b + d) % MODULUS] >= 0)
    return out


SHIFT = _shifts()


def matching(w: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Equal words from i and j on, at most ``most``, compared one after another."""
    out = np.zeros(len(i), np.int64)
    live = np.arange(len(i))
    for t in range(most):
        live = live[w[i[live] + t] == w[j[live] + t]]
        if not len(live):
            break
        out[live] = t + 1
    return out


class CoverIndex:
    """Longest common extensions to the right in ``w``, whose every two compared suffixes differ before its end."""

    def __init__(self, w: np.ndarray):
        self.w = np.concatenate((w, np.zeros(2 * MODULUS, w.dtype)))
        n = len(w)
        pos = np.arange(n)
        pos = pos[_SLOT[pos % MODULUS] >= 0]
        m = len(pos)
        # ranks by the first 13 words, as many words in a key as fit 62 bits
        bits = max(1, int(w.max()).bit_length())
        per = max(1, 62 // bits)
        keys = []
        for c in range(0, MODULUS, per):
            key = np.zeros(m, np.int64)
            for t in range(c, min(c + per, MODULUS)):
                key = (key << bits) | self.w[pos + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        differs = np.zeros(m, bool)
        for key in keys:
            differs[1:] |= key[order[1:]] != key[order[:-1]]
        rank = np.zeros(m, np.int32)
        rank[order] = np.maximum.accumulate(np.where(differs, np.arange(m), 0))
        levels, step = [rank], len(COVER)
        # doubling: only samples that share their rank are sorted again
        while True:
            sorted_rank = rank[order]
            twin = np.zeros(m, bool)
            twin[1:] = sorted_rank[1:] == sorted_rank[:-1]
            twin[:-1] |= twin[1:]
            at = np.flatnonzero(twin)
            if not len(at):
                break
            ids = order[at]
            then = np.concatenate((rank, np.full(step, -1, np.int32)))[np.minimum(ids + step, m + step - 1)]
            sub = np.lexsort((then, rank[ids]))
            ids, then = ids[sub], then[sub]
            new = np.ones(len(at), bool)
            new[1:] = (rank[ids[1:]] != rank[ids[:-1]]) | (then[1:] != then[:-1])
            order[at] = ids
            rank = rank.copy()
            rank[ids] = np.maximum.accumulate(np.where(new, at, 0))
            levels.append(rank)
            step *= 2
        self.rank = rank
        # common prefixes of neighbours in the order: whole levels from above, then words
        a, b = order[:-1].copy(), order[1:].copy()
        same = np.zeros(max(0, m - 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = len(COVER) << k
            wide = np.concatenate((levels[k], np.full(1, -1, np.int32)))
            eq = (a < m) & (b < m)
            eq &= wide[np.minimum(a, m)] == wide[np.minimum(b, m)]
            same += eq * (MODULUS << k)
            a, b = a + eq * step, b + eq * step
        left, right = pos[order[:-1]] + same, pos[order[1:]] + same
        table = [(same + matching(self.w, left, right, MODULUS - 1)).astype(np.int32)]
        half = 1
        while 2 * half <= len(table[0]):
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
            half *= 2
        self.table = table

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extension of positions i < j whose first 12 words are known to be equal."""
        d = SHIFT[i % MODULUS, j % MODULUS]
        a, b = (self.rank[(p // MODULUS) * len(COVER) + _SLOT[p % MODULUS]] for p in (i + d, j + d))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for level in np.unique(k):
            own = k == level
            t = self.table[level]
            out[own] = np.minimum(t[lo[own]], t[hi[own] - (1 << int(level))])
        return d + out


def extensions(w: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common extension to the right of every pair (i, j): a few words directly, the rest by the index of
    the documents that need it. ``doc`` is the document of each place of ``w``; a document's end belongs to it."""
    padded = np.concatenate((w, np.full(MODULUS, -1, w.dtype)))
    out = matching(padded, i, j, MODULUS - 1)
    open_ = np.flatnonzero(out == MODULUS - 1)
    if len(open_):
        keep = np.zeros(int(doc.max()) + 1, bool)
        keep[doc[i[open_]]] = True
        keep = keep[doc]
        place = np.cumsum(keep) - 1
        out[open_] = CoverIndex(w[keep]).extension(place[i[open_]], place[j[open_]])
    return out


def runs(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(document, start, length, period) of every run, by document, start and period. ``w`` are the documents'
    words as numbers >= 0 end to end (equal numbers: equal words); document d has counts[d]."""
    none = np.zeros((0, 4), np.int64)
    docs = len(counts)
    if not len(w):
        return none
    # an end of its own after each document, and one before the first
    base = int(w.max()) + 1
    own = np.repeat(np.arange(docs), counts)
    first = np.cumsum(counts) - counts + np.arange(docs) + 1  # place of each document's first word
    _, own_ids = np.unique(own * np.int64(base) + w, return_inverse=True)
    text = np.empty(len(w) + docs + 1, np.int64)
    ends = np.concatenate(([0], first + counts))
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = own_ids
    text[ends] = len(w) + np.arange(docs + 1)
    doc = np.searchsorted(ends, np.arange(len(text)), side="left") - 1  # an end closes its document
    doc[0] = 0
    back, back_doc = text[::-1].copy(), np.searchsorted(ends, np.arange(len(text)), side="right")[::-1] - 1
    back_doc = np.minimum(back_doc, docs - 1)
    # periods and grids
    per = np.where(counts >= MIN_WORDS, counts // MIN_PERIODS, 0)
    d = np.repeat(np.arange(docs), per)
    q = np.arange(len(d)) - np.repeat(np.cumsum(per) - per, per) + 1
    step = np.maximum(MIN_WORDS, MIN_PERIODS * q) - q
    grid = (counts[d] - q - 1) // step + 1
    found, done = [], np.concatenate(([0], np.cumsum(grid)))
    at = 0
    while at < len(d):
        to = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, side="right")) - 1)
        k = np.repeat(np.arange(at, to), grid[at:to])
        x = first[d[k]] + (np.arange(len(k)) - (done[k] - done[at])) * step[k]
        eq = text[x] == text[x + q[k]]
        found.append(np.stack((x[eq], q[k][eq])))
        at = to
    x, q = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    if not len(x):
        return none
    right = extensions(text, doc, x, x + q)
    turn = len(text) - 1
    left = extensions(back, back_doc, turn - (x + q) + 1, turn - x + 1)
    size = left + right + q
    long = size >= np.maximum(MIN_WORDS, MIN_PERIODS * q)
    start, size, q = (x - left)[long], size[long], q[long]
    at = np.lexsort((q, size, start))
    start, size, q = start[at], size[at], q[at]
    one = np.ones(len(at), bool)
    one[1:] = (start[1:] != start[:-1]) | (size[1:] != size[:-1])
    start, size, q = start[one], size[one], q[one]
    own = doc[start]
    out = np.stack((own, start - first[own], size, q), axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def word_numbers(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each word, words of each text): equal numbers exactly for equal bytes."""
    n = len(off) - 1
    solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    first = solid & ~(np.concatenate(([False], solid[:-1])) & ~edge[:-1])
    at = np.flatnonzero(first[solid])
    counts = np.diff(np.concatenate(([0], np.cumsum(first)))[off]) if n else np.zeros(0, np.int64)
    if not len(at):
        return np.zeros(0, np.int64), counts
    body = np.ascontiguousarray(raw[solid])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [
        None, pa.py_buffer(np.append(at, len(body)).astype(np.int64)), pa.py_buffer(body)])
    return np.asarray(words.dictionary_encode().indices, dtype=np.int64), counts


def rewritten(n: int, doc_id: int) -> np.ndarray | None:
    """Original word at each place of a document whose words are rewritten, else None."""
    mark = zlib.crc32(str(doc_id).encode())
    if mark % 10 or not n:
        return None
    g = mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def best(own: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run (start, length, period) with the greatest exact length / period; the first of equal ones."""
    top = None
    for r in own:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


SCHEMA = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _batches(rewrite: bool, with_text: bool):
    kinds = [(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in (x.split()[0] for x in SCHEMA.split(", "))]
    kinds = pa.schema(kinds + ([("runs", pa.list_(pa.list_(pa.int64()))), ("collapsed", pa.string())] if with_text else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in common.slices(batch):
                raw, off = common.text_buffer(b.column("text"))
                w, counts = word_numbers(raw, off)
                docs, data, first = b.column("doc_id").to_pylist(), raw.tobytes(), np.cumsum(counts) - counts
                source = {}
                for k, (d, n) in enumerate(zip(docs, counts.tolist(), strict=True)):
                    if rewrite and d is not None and (s := rewritten(n, d)) is not None:
                        source[k] = s
                        w[first[k]:first[k] + n] = w[first[k] + s]
                got = runs(w, counts)
                drop = np.zeros(len(w) + 1, np.int64)
                begin = first[got[:, 0]] + got[:, 1]
                np.add.at(drop, begin + got[:, 3], 1)
                np.add.at(drop, begin + got[:, 2], -1)
                stay = np.cumsum(drop)[:-1] == 0
                cut = np.searchsorted(got[:, 0], np.arange(len(docs) + 1))
                rows = []
                for k, d in enumerate(docs):
                    own = [tuple(r) for r in got[cut[k]:cut[k + 1], 1:].tolist()]
                    words = data[off[k]:off[k + 1]].split()
                    if k in source:
                        words = [words[i] for i in source[k].tolist()]
                    if own:
                        words = compress(words, stay[first[k]:first[k] + counts[k]].tolist())
                    text = b" ".join(words)
                    top = best(own)
                    rows.append((d, len(own), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
                                 hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest(),
                                 hashlib.sha256(text).hexdigest(), *((own, text.decode()) if with_text else ())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return run


def periodic_runs(docs: DataFrame, with_text: bool = True, rewrite: bool = False) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: number of runs, the strongest run, digests of all runs and of the words left
    when repetitions go; ``with_text``: also the ``runs`` (start, length, period) and the ``collapsed`` text. ``rewrite``
    plants periods by id first, as the query wants."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_batches(rewrite, with_text), SCHEMA + (", runs array<array<long>>, collapsed string" if with_text else ""))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(common.table(spark, sf_dir, "documents"), with_text=False, rewrite=True)
