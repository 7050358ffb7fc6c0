"""Token ids of whole texts with a public tokenizer file, cached by unit inside a task.

A text is cut where the file's pre-tokenizer always cuts: before a space or line feed that
follows a character which is surely not white space. Units are found and hashed (64 bits) on
the UTF-8 bytes of a whole Arrow slice; each distinct unit is encoded once by the tokenizers
library and the ids of a text are the ids of its units end to end. The strings of special
tokens in a text are ordinary text. Tokenizers are read from a path, never trained.

A unit that is one Latin word with marks behind it needs no pre-tokenizer: for the two kinds of file that
:func:`word_form` knows, its word and its marks go straight to the file's model. An encoder is
kept for the life of the Python worker, so that its units outlive a task.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from quarry.llm import common

#: Distinct units kept before the cache of a worker starts anew (bounded memory).
CACHE_UNITS = 1_000_000
#: Units encoded by one call, with a special token between them.
JOINED = 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def unit_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """First byte of every unit; each text begins one."""
    if not len(raw):
        return np.zeros(0, np.int64)
    prev = np.concatenate((raw[:1], raw[:-1]))
    lead = np.concatenate((raw[:1], raw[:1], raw[:-2]))[:len(raw)]
    # ASCII letters and signs, or a two-byte character from U+00C0 on: none is white space.
    solid = ((prev > 32) & (prev < 127)) | ((prev >= 0x80) & (prev < 0xC0) & (lead >= 0xC3) & (lead < 0xE0))
    cut = ((raw == 32) | (raw == 10)) & solid
    cut[off[:-1][off[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)


#: One word of Latin letters behind at most one space or line feed, then ASCII marks (no apostrophe, which may begin a clitic).
SIMPLE = re.compile(r"([ \n]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


def word_form(path: str) -> Callable[[str, str, str], list[str]] | None:
    """(space, word, marks) -> what the file's normalizer and pre-tokenizer make of a :data:`SIMPLE` unit, or None if they
    are of a kind not known here."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table = byte_letters()

    def letters(text: str) -> str:
        return text if text.isascii() else text.encode().decode("latin-1").translate(table)

    space, line = table[32], table[10]

    def kept_case(gap: str, word: str, marks: str) -> list[str]:
        word = letters(word)
        got = [line, word] if gap == "\n" else [space + word] if gap else [word]
        return [*got, marks] if marks else got

    def lower_case(gap: str, word: str, marks: str) -> list[str]:
        return [letters(word.lower()), marks] if marks else [letters(word.lower())]

    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    if not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return kept_case
    kinds = [x.get("type") for x in norm.get("normalizers", [])]
    steps = pre.get("pretokenizers", [])
    if (kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and steps[0].get("invert") and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")):
        return lower_case
    return None


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> UnitEncoder:
    """The worker's own encoder of a file."""
    return UnitEncoder(path)


class UnitEncoder:
    """ids(column) -> little-endian unsigned 32-bit ids of all texts and their n+1 offsets."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.marked = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.marked.token_to_id(self.mark)
        self.form = word_form(path)
        self.model = self.plain.model
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each unit) through the whole tokenizer."""
        if self.mark_id is None or any("<|" in u for u in units):
            got = [e.ids for e in self.plain.encode_batch_fast(units, add_special_tokens=False)]
            return np.fromiter(itertools.chain.from_iterable(got), "<u4"), np.array([len(x) for x in got], np.int64)
        joined = [self.mark.join(units[i:i + JOINED]) for i in range(0, len(units), JOINED)]
        ids = np.fromiter(itertools.chain.from_iterable(
            (*e.ids, self.mark_id) for e in self.marked.encode_batch_fast(joined, add_special_tokens=False)), "<u4")
        mark = ids == self.mark_id
        end = np.flatnonzero(mark)
        return ids[~mark], np.diff(np.concatenate(([-1], end))) - 1

    def encode_words(self, units: list[re.Match]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids of each unit) of matches of :data:`SIMPLE`, by the model alone."""
        tokenize, form = self.model.tokenize, self.form
        got = [[t.id for x in form(*m.groups()) for t in tokenize(x)] for m in units]
        return np.fromiter(itertools.chain.from_iterable(got), "<u4"), np.array([len(x) for x in got], np.int64)

    def learn(self, keys: np.ndarray, units: list[str]) -> None:
        found = [SIMPLE.fullmatch(u) if self.form else None for u in units]
        simple = np.array([m is not None for m in found], bool)
        keys = np.concatenate((keys[simple], keys[~simple]))
        parts = [self.encode_words([m for m in found if m is not None])]
        hard = [u for u, m in zip(units, found, strict=True) if m is None]
        parts += [self.encode_units(hard[i:i + 2000]) for i in range(0, len(hard), 2000)]
        size = np.concatenate([p[1] for p in parts])
        at = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, *[p[0] for p in parts]])
        keys, at, size = (np.concatenate(x) for x in ((self.keys, keys), (self.at, at), (self.size, size)))
        order = np.argsort(keys, kind="stable")  # two runs in ascending order, mostly
        self.keys, self.at, self.size = keys[order], at[order], size[order]

    def ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, off = common.text_buffer(col)
        first = unit_starts(raw, off)
        if not len(first):
            return np.zeros(0, "<u4"), np.zeros(len(off), np.int64)
        if len(self.keys) > CACHE_UNITS:
            self.forget()
        last = np.append(first[1:], len(raw))
        some, place, where = np.unique(common.run_hashes(raw, first), return_index=True, return_inverse=True)
        k = np.searchsorted(self.keys, some)
        new = np.ones(len(some), bool)
        inside = k < len(self.keys)
        new[inside] = self.keys[k[inside]] != some[inside]
        if new.any():
            data = raw.tobytes()
            own = place[new]
            self.learn(some[new], [data[a:b].decode() for a, b in zip(first[own].tolist(), last[own].tolist(), strict=True)])
            k = np.searchsorted(self.keys, some)
        k = k[where]
        size = self.size[k]
        end = np.cumsum(size)
        out = self.flat[np.repeat(self.at[k] - (end - size), size) + np.arange(end[-1])]
        # texts begin at units: the offset of a text is the ids before its first unit
        return out, np.concatenate(([0], end))[np.searchsorted(first, off)]
