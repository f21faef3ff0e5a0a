"""Token ids by two libraries, and the bytes that tokens stand for.

A byte-level vocabulary's pattern always cuts before a space that follows a character which isn't white space, and a
sentence-piece vocabulary does if none of its pieces goes on after such a space. So texts are split there, each distinct
part is encoded once by the libraries and remembered under its exact string, and ids are gathered; they are those of
encoding each text by itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from foliant.llm import textvec as tv

#: So many characters of new parts, about, go to the library in one call.
CALL_CHARS = 1 << 17
#: So many parts are joined and encoded as one text.
JOINED = 64
#: Where plain splitting at spaces would not do, and where it is safe then.
_UNSAFE, _SAFE = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenBytes:
    """The bytes of each id, laid out one after another."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.start = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        return self.flat[np.repeat(self.start[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))].tobytes()


def laid_out(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All lists' ids one after another, and how many each list has."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes


class ByteLevel:
    """Ids of texts by a byte-level BPE file; special strings inside texts are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        letters, vocab = byte_letters(), spec["model"]["vocab"] | added
        tokens = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            tokens[i] = word.encode() if word in added else bytes(letters[c] for c in word)
        self.bytes = TokenBytes(tokens)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of(self, parts: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts one after another, and how many each part has. ends: where parts end, in bytes. Parts are joined where a text would be cut between them."""
        groups = [parts[i : i + JOINED] for i in range(0, len(parts), JOINED)]
        joined = ["".join(g) for g in groups]
        flat, _ = laid_out(self._ids([x for g, j in zip(groups, joined, strict=True) for x in (g if _UNSAFE.search(j) else [j])]))
        reached = np.cumsum(self.bytes.size[flat])
        at = np.searchsorted(reached, ends)
        if len(flat) and at[-1] == len(flat) - 1 and np.array_equal(reached[at], ends):
            return flat, np.diff(at, prepend=-1)
        return laid_out(self._ids(parts))

    def _parts(self, text: str) -> list[str]:
        """Parts that can be encoded each by itself."""
        if _UNSAFE.search(text):
            return _SAFE.split(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + w for w in rest]


#: How a sentence-piece vocabulary writes a space.
BAR = "▁"


class Pieces:
    """Ids of texts by a sentence-piece file, which puts a space before each text."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        said = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.bytes = TokenBytes([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(BAR, " ").encode() for i, p in enumerate(said)])
        #: Whether no piece goes on after a space that follows something else, so that texts may be cut there.
        self.cuts = not any(re.search(f"[^{BAR}]{BAR}", p) for p in said)

    def ids_of(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of parts of texts, which begin with a space, one after another, and how many each part has."""
        alone = [self.library.piece_to_id(BAR)]
        return laid_out([ids if len(p) > 1 else alone for p, ids in zip(parts, self.library.encode([p[1:] for p in parts], num_threads=1), strict=True)])


def _sound(side: TokenBytes, ids: np.ndarray, sizes: np.ndarray, wanted: list[bytes], ends: np.ndarray) -> np.ndarray:
    """Of which parts the tokens join to the wanted bytes, which end there."""
    said = side.joined(ids)
    end = np.concatenate([[0], np.cumsum(side.size[ids])])[np.cumsum(sizes)]
    if np.array_equal(end, ends) and said == b"".join(wanted):
        return np.ones(len(wanted), bool)
    at = end.tolist()
    return np.array([said[i:j] == w for w, i, j in zip(wanted, [0, *at], at, strict=False)], bool)


class Paired:
    """The parts of texts, each distinct one encoded once by both libraries and remembered. A part begins with a space; the first has the one that the second library puts before a text."""

    def __init__(self, byte_file: str, piece_file: str):
        self.left, self.right = ByteLevel(byte_file), Pieces(piece_file)
        self.forget()

    def forget(self) -> None:
        """known: the number of each part; new: the numbers first given in the last call, from 0 after forgetting; sound: whether its tokens have its bytes; its ids are in a side's flat, by start."""
        self.known: dict[str, int] = {}
        self.new = range(0)
        self.chars, self.sound = 0, np.zeros(0, bool)
        self.flat, self.start = [np.zeros(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2

    def _learn(self, parts: list[str]) -> None:
        sound, flat, start = [self.sound], [[x] for x in self.flat], [[x] for x in self.start]
        for lo, hi in tv.chunks(parts, CALL_CHARS):
            wanted = [p.encode() for p in parts[lo:hi]]
            ends = np.cumsum(np.fromiter(map(len, wanted), np.int64, hi - lo))
            sound.append(np.ones(hi - lo, bool))
            for k, (side, (ids, sizes)) in enumerate(((self.left, self.left.ids_of(parts[lo:hi], ends)), (self.right, self.right.ids_of(parts[lo:hi])))):
                sound[-1] &= _sound(side.bytes, ids, sizes, wanted, ends)
                flat[k].append(ids)
                start[k].append(start[k][-1][-1] + np.cumsum(sizes))
        self.sound = np.concatenate(sound)
        self.flat, self.start = [np.concatenate(x) for x in flat], [np.concatenate(x) for x in start]
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts)), strict=True))
        self.chars += sum(map(len, parts))

    def _split(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.left._parts(" " + text) if self.right.cuts and BAR not in text else [" " + text]

    def parts_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' parts one after another, and where each text's begin (and one past the last). A text of which a part's tokens have other bytes has none."""
        split, before = [self._split(t) for t in texts], len(self.known)
        self._learn([p for p in dict.fromkeys(chain.from_iterable(split)) if p not in self.known])
        self.new = range(before, len(self.known))
        at = [np.fromiter(map(self.known.__getitem__, s), np.int64, len(s)) for s in split]
        at = [x if self.sound[x].all() else x[:0] for x in at]
        return np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int64)

    def tokens_of(self, numbers: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each side the ids of these parts one after another, their bytes, and how many each part has."""
        out = []
        for k, side in enumerate((self.left, self.right)):
            n = self.start[k][numbers + 1] - self.start[k][numbers]
            ids = self.flat[k][np.repeat(self.start[k][numbers] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            out.append((ids, side.bytes.size[ids], n))
        return out


@lru_cache(2)
def paired(byte_file: str, piece_file: str) -> Paired:
    return Paired(byte_file, piece_file)
