"""Operator 3: hierarchical Pitman-Yor language model, seated by Gibbs sampling.

Every word context is a restaurant; its customers are the words that follow it in training
texts, a table serves one word, and each table of a context sends a customer to the parent restaurant that all
contexts share, whose base measure is uniform over the V training types and one unknown type.
With c customers and t tables of word w, C and T of the restaurant, the prediction is

    p(w | u) = (c - d t) / (theta + C) + (theta + d T) / (theta + C) * p(w),

and likewise for the parent with its base. Seatings are sampled by Gibbs, a section (the customers of
one word in one restaurant) at a time: all customers of a section leave, and the number of tables at which they sit
anew is drawn from its exact distribution given the other words' tables T', where t tables weigh S(c, t) times the product of
(theta + d (T' + j)) p(w) over j < t, S being the generalised Stirling number of all ways to seat c customers at t tables. Only
the number of tables enters a prediction, so their sizes are summed out. The words of a restaurant take turns in ``TURNS``
groups; those of one group are drawn given the same tables. The rule is linear in the
tables, so averaged predictive probabilities are those of averaged table counts, level by
level. While contexts are seated the parent is held at the base unigram, its counts rounded to an eighth of a
binary logarithm; the parent is seated after them from their tables.

On Spark: texts are hashed (64 bits a word) into chunks with a dictionary each. A chunk sends each
dictionary word once to the word's partition and gets its corpus count and a number back
(small numbers for frequent words); it sends each distinct word pair once to the context's
partition, where whole restaurants are seated, and gets the pair's terms back; tables go on
to the word's partition for the parent. Every exchange carries distinct words or pairs of a
chunk, not tokens, so a frequent word or pair is a number. A context with a ``1 / FREQUENT``
share of all tokens or more is dealt by pairs instead; its total T is summed afterwards (at most ``FREQUENT``
such contexts exist, so their totals are broadcast), and while seating it is scaled from the part.

Tokens: words (runs of bytes other than ASCII white space, A-Z in lower case), then one end.
Edge cases: a null text is empty and has the end alone; a null id is a training row and not
held out; repeated rows all count and are scored; without training texts every probability is
that of the unknown type; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.common import squeezed, unsqueezed

_U = np.uint64
END = _U(1)
CHUNK_BYTES = 8 << 20
#: Text bytes per partition of words and contexts.
PART_BYTES = 8 << 20
#: Discounts and strengths of contexts and of their parent.
D2, THETA2, D1, THETA1 = 0.75, 1.0, 0.65, 10.0
ROUNDS, BURN_IN = 8, 3
#: Sections of more customers take their weights from this many by scaling.
EXACT = 1 << 12
#: Columns of the first try, cells of one block, and the logarithm of a weight that ends a section's columns.
NARROW, CELLS, NEGLIGIBLE = 64, 1 << 19, 35.0
#: The words of a restaurant are drawn in so many turns a round.
TURNS = 4
FREQUENT = 1000


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each run of equal values."""
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(sorted_)), bool), sorted_[1:] != sorted_[:-1])))
    return at, np.append(at[1:], len(sorted_))[:len(at)]


# ---------------------------------------------------------------- seating
def seatings(d: float, wanted: np.ndarray, width: int) -> np.ndarray:
    """Logarithm of the summed weights of all ways to seat n customers of one word at t tables, but for the new tables'
    own weights: row per n of ``wanted`` (ascending), column t - 1, -inf beyond n. With S(n, t) = S(n-1, t-1) +
    (n - 1 - d t) S(n-1, t). Beyond ``EXACT`` customers, t tables of n are as likely as t (EXACT / n)^d of EXACT: the
    sum of t independent table sizes has this scaling limit, off by some EXACT^-d (under 0.5 %)."""
    out = np.full((len(wanted), width), -np.inf)
    exact = wanted[wanted <= EXACT]
    over = wanted[wanted > EXACT]
    t = np.arange(1, width + 1)
    top = EXACT if len(over) else int(exact[-1])
    # the last row's columns that the scaling asks for, with two at least for its slope
    columns = min(top, width)
    row = np.full(columns, -np.inf)
    row[0] = 0.0
    at = dict(zip(exact.tolist(), range(len(exact)), strict=True))
    if 1 in at:
        out[at[1], 0] = 0.0
    with np.errstate(divide="ignore"):
        for n in range(2, top + 1):
            k = min(n, columns)
            stay = row[:k] + np.log(np.maximum(n - 1 - d * t[:k], 0))
            stay[1:] = np.logaddexp(stay[1:], row[:k - 1])
            row[:k] = stay
            if n in at:
                out[at[n], :k] = row[:k]
    if len(over):
        lf = np.cumsum(np.log(t))
        smooth = row + lf[:columns] + t[:columns] * np.log(d) - np.log(t[:columns])
        for i, n in enumerate(over.tolist(), len(exact)):
            k = min(n, width)
            as_if = t[:k] * (EXACT / n) ** d
            h = np.where(as_if < 1, smooth[0] + (smooth[1] - smooth[0]) * (as_if - 1), np.interp(as_if, t[:columns], smooth))
            out[i, :k] = h + np.log(t[:k]) - lf[:k] - t[:k] * np.log(d)
    return out


class Sections:
    """Draws the number of tables of many (restaurant, word) sections at once, given the tables of
    the other words. Section weights are tabulated once per width for all rounds."""

    def __init__(self, c: np.ndarray, d: float, theta: float):
        self.c, self.d, self.theta, self.tables = c, d, theta, {}

    def weights(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self.tables:
            # sections of up to half as many customers were whole in a narrower table
            wanted = np.unique(self.c[self.c > width // 2])
            wanted = wanted[wanted <= width] if width < NARROW else wanted
            self.tables[width] = wanted, seatings(self.d, wanted, width)
        return self.tables[width]

    def draw(self, rows: np.ndarray, others: np.ndarray, p: np.ndarray, rng) -> np.ndarray:
        """Tables of the sections ``rows`` (two customers or more), whose restaurants have ``others`` tables of other words."""
        out = np.empty(len(rows), np.int64)
        u = rng.random(len(rows))
        first = np.minimum(1 << np.ceil(np.log2(self.c[rows])).astype(np.int64), NARROW)
        todo, width = np.zeros(0, np.int64), 2
        while len(todo) or width <= NARROW:
            if width <= NARROW:
                todo = np.concatenate((todo, np.flatnonzero(first == width)))
            open_ = []
            if len(todo):
                wanted, table = self.weights(width)
                j = np.arange(width)
                step = max(1, CELLS // width)
                for a in range(0, len(todo), step):
                    x = todo[a:a + step]
                    w = table[np.searchsorted(wanted, self.c[rows[x]])]
                    w = w + np.cumsum(np.log((self.theta + self.d * (others[x, None] + j)) * p[x, None]), axis=1)
                    best = w.max(axis=1)
                    whole = (self.c[rows[x]] <= width) | (w[:, -1] < best - NEGLIGIBLE)
                    cum = np.cumsum(np.exp(w - best[:, None]), axis=1)
                    out[x] = 1 + np.minimum((u[x, None] * cum[:, -1:] >= cum).sum(axis=1), width - 1)
                    open_.append(x[~whole])
            todo = np.concatenate(open_) if open_ else np.zeros(0, np.int64)
            width *= 2
        return out


def seat(c: np.ndarray, room: np.ndarray, p: np.ndarray, d: float, theta: float, scale: np.ndarray, seed: int,
         rounds: int = ROUNDS, burn_in: int = BURN_IN) -> tuple[np.ndarray, np.ndarray]:
    """(mean tables over the kept rounds, tables of the last) of rows with ``c`` >= 1 customers
    of one word in restaurant ``room``, whose parent gives the word probability ``p``.
    ``scale``: what a restaurant's tables here are multiplied by for its total."""
    rng = np.random.default_rng(seed)
    t = np.ones(len(c), np.int64)
    sections = Sections(c, d, theta)
    some = np.flatnonzero(c > 1)
    some = some[np.argsort(room[some], kind="stable")]
    begin, end = runs(room[some])
    rank = np.arange(len(some)) - np.repeat(begin, end - begin)
    turns = [some[rank % TURNS == k] for k in range(TURNS)]
    total, kept = np.zeros(len(c)), 0
    for r in range(rounds):
        for rows in turns:
            if len(rows):
                all_ = np.bincount(room, t, len(scale)) * scale
                t[rows] = sections.draw(rows, np.maximum(all_[room[rows]] - t[rows], 0), p[rows], rng)
        if r >= burn_in:
            total, kept = total + t, kept + 1
    return (total / kept if kept else t.astype(float)), t


# ---------------------------------------------------------------- chunks
CHUNK = "chunk_id long, words binary, stream binary"


def chunked(docs: DataFrame) -> DataFrame:
    """chunk_id; words: dictionary hashes and their training counts; stream: dictionary
    places of all tokens (most frequent words first), tokens of each document, ids, folds."""

    def one(ids: list, hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[int, bytes, bytes]:
        counts = np.concatenate(counts)
        h = np.insert(np.concatenate(hashes), np.cumsum(counts), END)
        counts = counts + 1
        some, place, times = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        place = to[place]
        held = np.array([i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids], bool)
        train = np.bincount(place[~np.repeat(held, counts)], minlength=len(some))
        doc = np.array([0 if i is None else i for i in ids], np.int64)
        null = np.array([i is None for i in ids], np.uint8)
        return (random.getrandbits(62), squeezed([some[order], train.astype(np.uint32)]),
                squeezed([place.astype(np.uint32), counts.astype(np.int64), doc, null, held.astype(np.uint8)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        hashes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row = one(ids, hashes, counts)
            return pa.RecordBatch.from_arrays([pa.array([row[0]]), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.binary())],
                                              ["chunk_id", "words", "stream"])
        for big in batches:
            for b in common.slices(big, limit=2 << 20):
                raw, off = common.text_buffer(b.column("text"))
                h, n = common.words(raw, off, lower=True)
                ids += b.column("id").to_pylist()
                hashes.append(h)
                counts.append(n)
                size += len(raw) + 16 * b.num_rows
                if size >= CHUNK_BYTES:
                    yield flush()
                    ids, hashes, counts, size = [], [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CHUNK)


def answered(answers: DataFrame) -> DataFrame:
    return answers.groupBy("chunk_id").agg(F.collect_list(F.struct("kind", "part", "data")).alias("answers"))


def word_parts(some: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the dictionary by partition, partition of each in that order)."""
    to = (some % _U(parts)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, to[order]


def known_words(answers: list, n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, training count) of each dictionary word from the answers of kind 'word'."""
    number, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a in answers:
        if a["kind"] == "word":
            at, own, c = unsqueezed(a["data"])
            number[at], count[at] = own, c
    return number, count


def questions(place, counts, held, number, count, n_all: int, parts: int):
    """Distinct (context, word) pairs of a chunk that training can know, in the order they are
    sent: (partition, context place, word place, training count) and each token's pair (-1: none).
    The place after the last word is the begin of a text."""
    n = len(number)
    before = np.concatenate(([n], place[:-1])).astype(np.int64)
    before[np.cumsum(counts) - counts] = n
    seen = np.append(count > 0, True)
    asks = np.flatnonzero(seen[before] & seen[place])
    # contexts followed by unknown words alone ask with the end, for their own tables
    lone = np.setdiff1d(before[seen[before]], before[asks])
    key = np.concatenate(((before[asks] << 32) | place[asks], (lone << 32) | int(place[-1])))
    some, pair = np.unique(key, return_inverse=True)
    pair = pair[:len(asks)]
    u, w = some >> 32, some & 0xFFFFFFFF
    train = np.bincount(pair, (~np.repeat(held, counts))[asks], len(some)).astype(np.int64)
    nu, nw = np.append(number, 0)[u], number[w]
    hot = np.append(count, 0)[u] * FREQUENT >= n_all
    part = common.mix64(np.where(hot, nu.astype(_U) ^ common.mix64(nw.astype(_U)), nu.astype(_U))) % _U(parts)
    order = np.lexsort((nw, nu, part))
    to = np.empty(len(order), np.int64)
    to[order] = np.arange(len(order))
    pairs = np.full(len(place), -1, np.int64)
    pairs[asks] = to[pair]
    return part[order].astype(np.int64), u[order], w[order], train[order], pairs, before


def score(docs: DataFrame, rounds: int = ROUNDS, burn_in: int = BURN_IN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    chunks = common.stored(chunked(docs), "lm-chunks")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    # by the data alone: numbers and draws are the same whatever the session's settings
    parts = max(1, -(-size // PART_BYTES))
    reply = "kind string, chunk_id long, part long, data binary, types long, tokens long"

    # words: corpus counts and numbers
    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, words in zip(b.column("chunk_id").to_pylist(), b.column("words").to_pylist(), strict=True):
                some, train = unsqueezed(words)
                order, to = word_parts(some, parts)
                a, z = runs(to)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[a], pa.int64()), pa.array([chunk] * len(a), pa.int64()),
                     pa.array([squeezed([order[x:y].astype(np.uint32), some[order[x:y]], train[order[x:y]]])
                               for x, y in zip(a, z, strict=True)], pa.binary())], ["part", "chunk_id", "data"])

    def count_words(t: pa.Table) -> pa.Table:
        part, got = t.column("part")[0].as_py(), [unsqueezed(x) for x in t.column("data").to_pylist()]
        some, where = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
        c = np.bincount(where, np.concatenate([g[2] for g in got]), len(some)).astype(np.int64)
        rank = np.empty(len(some), np.int64)
        rank[np.lexsort((some, -c))] = np.arange(len(some))
        number = 1 + rank * parts + part
        ends = np.cumsum([len(g[0]) for g in got])
        data = [squeezed([g[0], number[where[e - len(g[0]):e]], c[where[e - len(g[0]):e]]]) for g, e in zip(got, ends, strict=True)]
        first = np.zeros(len(got), np.int64)
        first[:1] = 1
        return pa.table({"kind": pa.array(["word"] * len(got)), "chunk_id": t.column("chunk_id"), "part": t.column("part"),
                         "data": pa.array(data, pa.binary()), "types": pa.array(first * int((c > 0).sum())),
                         "tokens": pa.array(first * int(c.sum()))})

    asked = chunks.select("chunk_id", "words").mapInArrow(ask_words, "part long, chunk_id long, data binary")
    words = common.stored(asked.groupBy("part").applyInArrow(count_words, reply), "lm-words")
    row = words.agg(F.sum("types"), F.sum("tokens")).first()
    n_types, n_all = row[0] or 0, row[1] or 0
    word_answers = words.select("kind", "chunk_id", "part", "data")

    # contexts: seat the restaurants
    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, stream, answers in zip(*(b.column(c).to_pylist() for c in ("chunk_id", "stream", "answers")), strict=True):
                place, counts, _, _, held = unsqueezed(stream)
                n = int(place.max()) + 1
                number, count = known_words(answers, n, parts)
                part, u, w, train, _, _ = questions(place, counts, held.astype(bool), number, count, n_all, parts)
                nu, nw, cu, cw = np.append(number, 0)[u], number[w], np.append(count, 0)[u], count[w]
                level = np.round(8 * np.log2(np.maximum(cw, 1))).astype(np.uint8 if n_all < 1 << 31 else np.uint16)
                a, z = runs(part)
                rows = []
                for x, y in zip(a, z, strict=True):
                    f, g = runs(nu[x:y])
                    rows.append(squeezed([np.diff(nu[x:y][f], prepend=0), cu[x:y][f], (g - f).astype(np.uint32), nw[x:y],
                                          train[x:y].astype(np.uint32), level[x:y]]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(part[a]), pa.array([chunk] * len(a), pa.int64()),
                                                      pa.array(rows, pa.binary())], ["part", "chunk_id", "data"])

    def seat_contexts(t: pa.Table) -> pa.Table:
        part, chunk = t.column("part")[0].as_py(), t.column("chunk_id").to_pylist()
        got = [unsqueezed(x) for x in t.column("data").to_pylist()]
        us = np.concatenate([np.cumsum(g[0]) for g in got])
        many = np.concatenate([g[2] for g in got]).astype(np.int64)
        contexts, room = np.unique(us, return_inverse=True)
        total = np.zeros(len(contexts), np.int64)
        total[room] = np.concatenate([g[1] for g in got])
        w, wi = np.unique(np.concatenate([g[3] for g in got]), return_inverse=True)
        key, where = np.unique((np.repeat(room, many).astype(np.int64) << 32) | wi, return_inverse=True)
        c = np.bincount(where, np.concatenate([g[4] for g in got]), len(key)).astype(np.int64)
        level = np.zeros(len(w))
        level[wi] = np.concatenate([g[5] for g in got])
        p = (2.0 ** (level / 8) + 0.5) / (n_all + 0.5 * (n_types + 1))
        live = np.flatnonzero(c > 0)
        own, word = key[live] >> 32, key[live] & 0xFFFFFFFF
        here = np.bincount(own, c[live], len(contexts))
        # the begin of a text has number 0 and no count of its own: it is whole where it is
        full = np.where(contexts > 0, np.maximum(total, here), here)
        hot = (contexts > 0) & (total * FREQUENT >= n_all)
        scale = np.where(hot, full / np.maximum(here, 1), 1.0)
        mean, last = seat(c[live], own, p[word], D2, THETA2, scale, part + 1, rounds, burn_in)
        x = np.zeros(len(key), np.float32)
        x[live] = c[live] - D2 * mean
        tables = np.bincount(own, mean, len(contexts)).astype(np.float32)
        rows = {"kind": [], "chunk_id": [], "part": [], "data": []}
        e = f = 0
        for k, g in zip(chunk, got, strict=True):
            a, e = e, e + len(g[0])
            b, f = f, f + len(g[3])
            for name, v in (("kind", "pair"), ("chunk_id", k), ("part", part),
                            ("data", squeezed([x[where[b:f]], tables[room[a:e]]]))):
                rows[name].append(v)
        sent = np.bincount(word, last, len(w)).astype(np.int64)
        at = np.flatnonzero(sent)
        order = at[np.argsort((w[at] - 1) % parts, kind="stable")]
        a, z = runs((w[order] - 1) % parts)
        for i, j in zip(a.tolist(), z.tolist(), strict=True):
            o = order[i:j]
            for name, v in (("kind", "tables"), ("chunk_id", None), ("part", int((w[o[0]] - 1) % parts)),
                            ("data", squeezed([(w[o] - 1) // parts, sent[o]]))):
                rows[name].append(v)
        if hot.any():
            for name, v in (("kind", "hot"), ("chunk_id", None), ("part", part),
                            ("data", squeezed([contexts[hot], tables[hot].astype(np.float64)]))):
                rows[name].append(v)
        return pa.table({"kind": pa.array(rows["kind"]), "chunk_id": pa.array(rows["chunk_id"], pa.int64()),
                         "part": pa.array(rows["part"], pa.int64()), "data": pa.array(rows["data"], pa.binary())})

    kinds = "kind string, chunk_id long, part long, data binary"
    asked = chunks.select("chunk_id", "stream").join(answered(word_answers), "chunk_id").mapInArrow(
        ask_pairs, "part long, chunk_id long, data binary")
    seated = common.stored(asked.groupBy("part").applyInArrow(seat_contexts, kinds), "lm-contexts")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                u, t = unsqueezed(data)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(t)], ["u", "t"])

    # at most FREQUENT contexts have such a share of the tokens
    hot = {r["u"]: r["t"] for r in seated.where("kind = 'hot'").select("data").mapInArrow(unpack, "u long, t double")
           .groupBy("u").agg(F.sum("t").alias("t")).collect()}

    # the parent: customers are the tables of all contexts
    def seat_parent(t: pa.Table) -> pa.Table:
        part, kind = t.column("part")[0].as_py(), t.column("kind").to_pylist()
        chunk, data = t.column("chunk_id").to_pylist(), [unsqueezed(x) for x in t.column("data").to_pylist()]
        sent = [d for k, d in zip(kind, data, strict=True) if k == "tables"]
        rank = np.concatenate([d[0] for d in sent]) if sent else np.zeros(0, np.int64)
        n = np.bincount(rank, np.concatenate([d[1] for d in sent]), 0).astype(np.int64) if sent else np.zeros(0, np.int64)
        live = np.flatnonzero(n)
        scale = np.array([n_types / max(1, len(live))])
        mean, _ = seat(n[live], np.zeros(len(live), np.int64), np.full(len(live), 1 / (n_types + 1)), D1, THETA1, scale,
                       part + 1, rounds, burn_in)
        x = np.zeros(len(n) + 1, np.float64)
        x[live] = n[live] - D1 * mean
        rows = []
        for k, c, d in zip(kind, chunk, data, strict=True):
            if k == "word":
                r = (d[1] - 1) // parts
                rows.append((c, squeezed([d[0], x[np.where(r < len(n), r, len(n))].astype(np.float32)])))
        m = len(rows)
        return pa.table({"kind": pa.array(["parent"] * m), "chunk_id": pa.array([r[0] for r in rows], pa.int64()),
                         "part": pa.array([part] * m, pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary()),
                         "tables": pa.array([float(mean.sum())] + [0.0] * (m - 1) if m else [], pa.float64()),
                         "customers": pa.array([float(n.sum())] + [0.0] * (m - 1) if m else [], pa.float64())})

    sent = seated.where("kind = 'tables'")
    parent = common.stored(word_answers.unionByName(sent).groupBy("part").applyInArrow(
        seat_parent, kinds + ", tables double, customers double"), "lm-parent")
    row = parent.agg(F.sum("tables"), F.sum("customers")).first()
    t_all, c_all = row[0] or 0.0, row[1] or 0.0

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    kinds_out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                           ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream, answers in zip(b.column("stream").to_pylist(), b.column("answers").to_pylist(), strict=True):
                place, counts, doc, null, held = unsqueezed(stream)
                place, held = place.astype(np.int64), held.astype(bool)
                n = int(place.max()) + 1
                number, count = known_words(answers, n, parts)
                part, u, w, _, pairs, before = questions(place, counts, held, number, count, n_all, parts)
                parent_x = np.zeros(n)
                x, tables = np.zeros(len(u) + 1), np.zeros(n + 1)
                a, z = runs(part)
                at = dict(zip(part[a].tolist(), zip(a.tolist(), z.tolist(), strict=True), strict=True))
                for r in answers:
                    if r["kind"] == "parent":
                        i, v = unsqueezed(r["data"])
                        parent_x[i] = v
                    elif r["kind"] == "pair":
                        i, j = at[r["part"]]
                        v, t = unsqueezed(r["data"])
                        x[i:j] = v
                        # contexts were sent in the order of their numbers
                        f, _ = runs(np.append(number, 0)[u[i:j]])
                        tables[u[i:j][f]] = t
                for k in np.flatnonzero(np.isin(number, list(hot))):
                    tables[k] = hot[int(number[k])]
                base = (parent_x + (THETA1 + D1 * t_all) / (n_types + 1)) / (THETA1 + c_all)
                customers = np.append(count, begins).astype(np.float64)
                whole = THETA2 + customers
                back = np.where(customers > 0, (THETA2 + D2 * tables) / whole, 1.0)
                p = x[pairs] / whole[before] * (pairs >= 0) + back[before] * base[place]
                first = np.cumsum(counts) - counts
                known = count[place] > 0
                plain = np.log10((count[place] + 0.5) / (n_all + 0.5 * (n_types + 1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=null.astype(bool)), pa.array(held), pa.array(counts),
                     pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.full(len(doc), n_all, np.int64)),
                     pa.array(np.add.reduceat(plain, first)), pa.array(np.add.reduceat(np.log10(p), first))], schema=kinds_out)

    # a text begins as often as it ends: training documents
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string")), F.lit(5)) != 1, F.lit(True))
    begins = docs.where(fold).count()
    answers = word_answers.unionByName(seated.where("kind = 'pair'")).unionByName(parent.select("kind", "chunk_id", "part", "data"))
    return chunks.select("chunk_id", "stream").join(answered(answers), "chunk_id").select("stream", "answers").mapInArrow(finish, out)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
