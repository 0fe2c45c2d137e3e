"""Rabin-Karp hashes of word windows, vectorised over the words of many documents at once.

A word's codes come from a keyed cryptographic hash of its bytes, once for each distinct word. A window's hash is the
polynomial of its words' codes at a fixed base, modulo the primes 2 ** 61 - 1 and 2 ** 31 - 1, so that no choice of words
makes different windows collide more often than chance does (powers of two as moduli would).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np

P61, P31 = 2**61 - 1, 2**31 - 1
_KEY = b"word windows 1"
_seeded = np.random.Generator(np.random.PCG64(20240229))
BASE61, BASE31 = int(_seeded.integers(2**60, P61)), int(_seeded.integers(2**30, P31))
_U = np.uint64
#: Distinct words that a vocabulary holds before it starts anew.
MOST_WORDS = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def times61(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo 2 ** 61 - 1, for x and c below that: halves of 31 bits, as 2 ** 61 counts as 1."""
    high, low, a, b = x >> _U(31), x & _U(P31), _U(c >> 31), _U(c & P31)
    middle = high * b + low * a
    total = high * a * _U(2) + (middle >> _U(30)) + ((middle & _U(2**30 - 1)) << _U(31)) + low * b
    return reduced61(total)


def reduced61(x: np.ndarray) -> np.ndarray:
    x = (x & _U(P61)) + (x >> _U(61))
    return np.where(x >= _U(P61), x - _U(P61), x)


def times31(x: np.ndarray, c: int) -> np.ndarray:
    return reduced31(x * _U(c))


def reduced31(x: np.ndarray) -> np.ndarray:
    x = (x & _U(P31)) + (x >> _U(31))
    x = (x & _U(P31)) + (x >> _U(31))
    return np.where(x >= _U(P31), x - _U(P31), x)


def _windows(codes: np.ndarray, width: int, base: int, prime: int) -> np.ndarray:
    """The polynomial of every `width` codes in a row: windows of 1, 2, 4 .. codes are doubled and put together."""
    times, reduced = (times61, reduced61) if prime == P61 else (times31, reduced31)
    n, have, at, power, length = len(codes), None, 0, codes, 1
    while width >> at:
        if width >> at & 1:
            # `have` covers the bits so far, and stands behind this power of two
            bits = width & ((1 << at) - 1)
            have = power if have is None else reduced(times(power[: n - length - bits + 1], pow(base, bits, prime)) + have[length : length + n - length - bits + 1])
        at += 1
        if width >> at:
            power = reduced(times(power[: n - 2 * length + 1], pow(base, length, prime)) + power[length : length + n - 2 * length + 1])
            length *= 2
    return have


class Words(dict):
    """Codes of words: indices into tables of 61 and 31 bits that grow with the words seen."""

    def __init__(self):
        super().__init__()
        self.digests: list[bytes] = []
        self.table = np.zeros((0, 2), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self.digests)
        self.digests.append(hashlib.blake2b(word, digest_size=16, key=_KEY).digest())
        return at

    def codes(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes below 2 ** 61 - 1 and below 2 ** 31 - 1 of all words in order, and the number of words of each text."""
        if len(self.digests) > MOST_WORDS:
            self.clear()
            self.digests, self.table = [], np.zeros((0, 2), dtype=np.uint64)
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(counts.sum()))
        if len(self.table) < len(self.digests):
            new = np.frombuffer(b"".join(self.digests[len(self.table) :]), dtype=np.uint64).reshape(-1, 2)
            self.table = np.concatenate([self.table, np.stack([new[:, 0] % _U(P61), new[:, 1] % _U(P31)], axis=1)])
        return self.table[at, 0], self.table[at, 1], counts


def starts(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `width` words within one text: its text's number, and the place of its first word among all."""
    per = np.maximum(counts - width + 1, 0)
    of = np.repeat(np.arange(len(counts)), per)
    return of, np.arange(len(of)) + np.repeat(np.cumsum(counts) - counts - np.cumsum(per) + per, per)


def windows(codes: tuple[np.ndarray, np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of `width` words within one text: 64 and 28 bits of its two hashes, and its text's number."""
    first, second, counts = codes
    of, at = starts(counts, width)
    if not len(of):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32), of
    b = _windows(second, width, BASE31, P31)[at]
    return _windows(first, width, BASE61, P61)[at] << _U(3) | b >> _U(28), (b & _U(2**28 - 1)).astype(np.uint32), of


def ordered(key: np.ndarray, rest: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal hashes together (by `then` within them, else as they come), and where another hash begins."""
    order = np.lexsort((*then[::-1], key)) if then else np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.zeros(0, dtype=bool)
    if ((rest[order][1:] != rest[order][:-1]) & ~new[1:]).any():  # 64 bits alone don't tell them apart
        order = np.lexsort((*then[::-1], rest, key))
        new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (rest[order][1:] != rest[order][:-1])))
    return order, new


def chunks(rows: Iterator, limit: int) -> Iterator[list]:
    """Split an iterator of (key, text) into lists of about `limit` bytes of text; one long text is a list of its own."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1]) > limit:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held
