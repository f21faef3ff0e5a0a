"""Numpy helpers over batches of texts: code points, runs of characters, hashes of runs.

A batch of texts becomes one array of code points; words are runs of a character class, and each run gets a 64-bit
polynomial hash from one prefix sum, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: A chunk of texts has about so many characters; a longer text is a chunk of its own.
CHUNK_CHARS = 1_000_000

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = max(CHUNK_CHARS + 4096, 1 << max(1, int(n - 1).bit_length()) if n > CHUNK_CHARS + 4096 else 0)
    if size not in _powers:
        if len(_powers) > 1:
            _powers.clear()
        made = []
        for p in (_P, _PINV):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        _powers[size] = (made[0], made[1])
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose lengths sum to about the limit."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each text followed by a line feed, and the place where each text starts (and one past the last)."""
    whole = "\n".join(t or "" for t in texts) + "\n"
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or "") + 1 for t in texts], out=starts[1:])
    return cp, starts


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of True."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(mask)]])
    return edge[::2], edge[1::2]


def run_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points, for buckets of features; equal runs have equal hashes, and some long crafted ones that differ have too."""
    power, inverse = _power(len(cp) + 1)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum((cp + np.uint64(1)) * power[: len(cp)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of code points, where words must be told apart: place and character are mixed before they are summed, so no pattern of a word cancels another's."""
    n = ends - starts
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    each = mix(mix(cp[place + np.repeat(starts, n)] + (place.astype(np.uint64) << np.uint64(21))) + np.uint64(_P))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each)])
    last = np.cumsum(n)
    return mix(total[last] - total[last - n] + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(128, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def is_space(cp: np.ndarray) -> np.ndarray:
    """The characters [\\x20\\x09-\\x0D]."""
    return _SPACE[np.minimum(cp, 127)]


def lower_ascii(cp: np.ndarray) -> np.ndarray:
    return cp + ((cp >= 65) & (cp <= 90)).astype(np.uint32) * np.uint32(32)


def words(cp: np.ndarray, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+: their starts, ends, and for each text the place of its first word (and one past the last)."""
    s, e = runs(~is_space(cp))
    return s, e, np.searchsorted(s, doc_starts)
