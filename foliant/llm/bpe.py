"""Token ids of whole texts by a byte-level BPE vocabulary, a batch of texts at a time.

The vocabulary's own pattern cuts a text into pieces that are merged independently. Here the cuts are found for a whole
batch with numpy, each distinct piece is encoded once by the library and remembered, and the ids are gathered. They are
those of encoding each text by itself. Pieces are found again by a hash, and then compared letter by letter. The library
is given whole texts where that can't be relied on: those with an English contraction, which the pattern cuts differently,
with one of the vocabulary's added tokens, with characters whose class depends on the version of Unicode, and with
pieces that share a hash with another.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from tokenizers import Tokenizer

from foliant.llm import textvec as tv

#: Pieces remembered at most; then memory starts anew.
MEMORY = 600_000
#: Letters with which a contraction may begin.
_AFTER = np.zeros(128, bool)
_AFTER[[ord(c) for c in "stmdrvl"]] = True
OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point, and for which it is the same in all versions of Unicode."""
    found = np.zeros(0x110000, np.uint8)
    at = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
    every = at.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        found[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    first = {"L": LETTER, "N": NUMBER}
    old = np.fromiter((9 if (c := unicodedata.ucd_3_2_0.category(x)) == "Cn" else first.get(c[0], OTHER) for x in every), np.uint8, len(every))
    steady = np.zeros(0x110000, bool)
    steady[at] = old == np.where(found[at] == SPACE, OTHER, found[at])
    return found, steady


@lru_cache(2)
def encoder(path: str) -> TextIds:
    return TextIds(path)


class TextIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            self.added = tuple(x["content"] for x in json.load(f).get("added_tokens", ()))
        self.library = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        """known: sorted hashes of pieces; place: where each one's ids are in flat, by start, and its letters in letters, by begin."""
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.letters, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode pieces that aren't known."""
        each = self._ids(pieces)
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        place = np.concatenate([self.place, np.arange(len(pieces)) + len(self.start) - 1])
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in each for i in x), np.int32, int(sizes.sum()))])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
        self.letters = np.concatenate([self.letters, np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(p) for p in pieces])])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.place = known[order], place[order]

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hashes are among the known, and which are there."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return at, self.known[at] == hashes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (and one past the last)."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        cp, at = tv.codepoints(texts)
        whole = "\n".join(t or "" for t in texts) + "\n"
        classes, steady = _classes()
        kind = classes[cp]
        kind[at[1:] - 1] = BREAK
        change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        lo = np.concatenate([[0], change])
        hi = np.concatenate([change, [len(cp)]])
        of = kind[lo]
        follow = np.append(of[1:], BREAK)
        solid, blank = of < SPACE, of == SPACE
        glued = np.zeros(len(lo), bool)
        glued[1:] = solid[1:] & (of[:-1] == SPACE) & (cp[lo[1:] - 1] == 32)
        last_alone = blank & (follow != BREAK) & (cp[hi - 1] != 32)
        begins = blank & ((follow == BREAK) | (hi - lo > 1) | last_alone)
        starts = np.concatenate([lo[solid] - glued[solid], lo[begins], (hi - 1)[last_alone & (hi - lo > 1)], at[1:] - 1])
        starts.sort()
        ends = np.append(starts[1:], len(cp))
        real = kind[starts] != BREAK
        starts, ends = starts[real], ends[real]
        if len(self.start) > MEMORY:
            self._forget()
        codes, distinct = pd.factorize(tv.word_hashes(cp, starts, ends))
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        _, there = self._places(distinct)
        fresh = np.flatnonzero(~there)
        if len(fresh):
            self._learn(distinct[fresh], [whole[i:j] for i, j in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)])
        word = self.place[self._places(distinct)[0]][codes] if len(codes) else np.zeros(0, np.int64)
        begin, flat = self.start, self.flat
        size = begin[word + 1] - begin[word]
        after = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(begin[word] - after[:-1], size) + np.arange(after[-1])]
        bounds = after[np.searchsorted(starts, at)]
        return self._with_odd(texts, cp, at, ids, bounds, np.concatenate([starts[~self._same(cp, starts, ends, word)], np.flatnonzero(~steady[cp])]))

    def _same(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Which pieces are, letter by letter, the ones that their hashes stand for."""
        n = ends - starts
        good = n == self.begin[word + 1] - self.begin[word]
        s, b, m = starts[good], self.begin[word[good]], n[good]
        step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        differ = np.flatnonzero(cp[np.repeat(s, m) + step] != self.letters[np.repeat(b, m) + step])
        good[np.flatnonzero(good)[np.searchsorted(np.cumsum(m), differ, "right")]] = False
        return good

    def _with_odd(self, texts: list[str | None], cp: np.ndarray, at: np.ndarray, ids: np.ndarray, bounds: np.ndarray, odd_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids, those of texts with something odd at these places or otherwise by the library."""
        mark = np.flatnonzero((cp[:-1] == 39) & _AFTER[np.minimum(cp[1:], 127)])
        odd = set((np.searchsorted(at, np.concatenate([mark, odd_at]), "right") - 1).tolist())
        odd |= {i for i, t in enumerate(texts) if t and any(x in t for x in self.added)}
        if not odd:
            return ids, bounds
        parts = [np.array(self._ids([texts[i]])[0] if texts[i] else [], np.int32) if i in odd else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
