"""Vectorised words and word windows of a batch of texts.

A batch is a list of UTF-8 byte strings.  ``Words`` finds every word of every
text with a 256-entry byte table, hashes each word to 64 bits and keeps the
word-to-text bookkeeping, all in numpy; ``window_hashes`` combines the hashes
of k consecutive words.  Nothing here knows about Spark: operators call it from
inside ``mapInArrow`` so that one task holds only a small batch at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np

#: The six ASCII blanks that separate words.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

_U = np.uint64
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=_U)
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 64
#: Low bits that index the bit table of a ``Shelf``.
_BITS = 20


def _table(pred) -> np.ndarray:
    return np.array([pred(b) for b in range(256)], dtype=bool)


#: Any run of bytes that are not ASCII blanks.
PLAIN = _table(lambda b: b not in BLANKS)
#: Digits, lower-case a-z and everything outside ASCII (texts are lower-cased first).
ALNUM = _table(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Lower-case a-z and everything outside ASCII.
LETTERS = _table(lambda b: 97 <= b <= 122 or b >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x ^ (x >> _U(30))
    x *= _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


def batches(items: Iterable, size_of, target: int = 1 << 20) -> Iterator[list]:
    """Cut ``items`` into lists of about ``target`` bytes; one item may exceed it."""
    out, total = [], 0
    for item in items:
        out.append(item)
        total += size_of(item)
        if total >= target:
            yield out
            out, total = [], 0
    if out:
        yield out


class Words:
    """Words of a batch of texts.

    ``starts``/``ends`` are byte offsets into ``raw``; ``hash`` is one uint64 per
    word; ``first[i]:first[i + 1]`` are the words of text ``i``; ``text_of`` maps
    a word to its text.
    """

    def __init__(self, texts: list[bytes], table: np.ndarray = PLAIN):
        self.raw = b"\n".join(texts) + b"\n" + b"\0" * 8
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        self.buf = buf
        body = len(self.raw) - 8
        inside = np.zeros(body + 1, dtype=np.int8)
        inside[1:] = table[buf[:body]]
        step = np.diff(inside)
        self.starts = np.flatnonzero(step == 1)
        self.ends = np.flatnonzero(step == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.starts, self.text_start)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(texts)), self.counts)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        n = len(self.starts)
        size = self.ends - self.starts
        h = mix(size.astype(_U) * _GOLD + _GOLD)
        eights = np.ndarray((len(self.raw) - 7,), dtype="<u8", buffer=self.raw, strides=(1,))
        todo, off = np.arange(n), 0
        while len(todo) and off < LONG_WORD:
            part = eights[self.starts[todo] + off] & _KEEP[np.minimum(size[todo] - off, 8)]
            h[todo] = mix((h[todo] ^ part) * _GOLD + _M1)
            off += 8
            todo = todo[size[todo] > off]
        for i in todo:
            word = self.raw[self.starts[i] : self.ends[i]]
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]

    def fits(self, k: int) -> np.ndarray:
        """For each position of ``window_hashes(k)``: is the window inside one text?"""
        n = len(self.text_of)
        if n < k:
            return np.zeros(0, dtype=bool)
        return self.text_of[: n - k + 1] == self.text_of[k - 1 :]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of ``h[i:i + k]`` for every i, by doubling."""
    if len(h) < k:
        return np.zeros(0, dtype=_U)
    power, width, out, done = h, 1, None, 0
    rest = k
    while rest:
        if rest & 1:
            if out is None:
                out, done = power, width
            else:
                m = len(h) - (done + width) + 1
                out = mix(out[:m] * _M2 + power[done : done + m] + _U(done + width))
                done += width
        rest >>= 1
        if rest:
            m = len(power) - width
            power = mix(power[:m] * _M1 + power[width : width + m] + _U(2 * width))
            width *= 2
    return out[: len(h) - k + 1]


def text_bytes(values: Iterable) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in values]


class Shelf:
    """A set of hashes with fast look-up: a bit table first, then binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << _BITS, dtype=bool)
        self.table[(self.keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are in the set, and their index among the keys."""
        at = np.flatnonzero(self.table[(h & np.uint64((1 << _BITS) - 1)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]
