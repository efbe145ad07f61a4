"""The first 32 bits of the MD5 of many short texts that share a beginning, as whole-array operations.

Texts lie in rows of words, whatever their lengths; words that all texts share stay numbers, and what depends on them alone
is worked out once, so few arrays are read. Each text, with its beginning, must fit one block of MD5 (55 bytes).
"""

from __future__ import annotations

import math

import numpy as np

LONGEST = 55
#: Texts worked on at once, so that arrays stay in a core's cache.
CHUNK = 32768
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF
#: By step: constant, shift, number of the word. The last three of 64 steps do not reach the first word of the result.
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(61)]
_S = [_SHIFTS[i // 16][i % 4] for i in range(61)]
_WORD = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, (7 * i) % 16)[i // 16] for i in range(61)]


def _number(x: int) -> np.ndarray:
    """An operand that NumPy takes without a conversion."""
    return np.array(x, dtype=np.uint32)


_K_NUMBER, _LEFT, _RIGHT = [_number(k) for k in _K], [_number(s) for s in _S], [_number(32 - s) for s in _S]


class Texts:
    """ASCII texts, filled up with zero bytes to one width, as columns of little-endian words for each place that they may
    begin at in a word."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray | None = None):
        self.n, self.length = letters.shape
        self.lengths = np.full(self.n, self.length) if lengths is None else np.asarray(lengths)
        self._letters, self._words, self._bits = letters, {}, {}

    def words(self, place: int) -> np.ndarray:
        if place not in self._words:
            out = np.zeros((self.n, -(-(place + self.length + 1) // 4) * 4), dtype=np.uint8)
            out[:, place : place + self.length] = self._letters
            out[np.arange(self.n), place + self.lengths] = 0x80
            self._words[place] = np.ascontiguousarray(out.view("<u4").T)
        return self._words[place]

    def bits(self, at: int, before: int) -> int | np.ndarray:
        """Length in bits, with so many bytes before, of the chunk's texts that begin there: a number if they share it."""
        if at not in self._bits:
            own = self.lengths[at : at + CHUNK]
            self._bits[at] = int(own[0]) if (own == own[0]).all() else own.astype(np.uint32)
        own = self._bits[at]
        return 8 * (before + own) if isinstance(own, int) else (own + np.uint32(before)) * np.uint32(8)


def first_bits(beginning: bytes, texts: Texts) -> np.ndarray:
    """Of each text after the beginning: the first eight hex digits of its MD5, as a number."""
    size = len(beginning) + texts.length
    if size > LONGEST:
        raise ValueError(f"{size} bytes are more than one block of MD5 takes")
    first, place = divmod(len(beginning), 4)
    shared = np.frombuffer(beginning + bytes(-len(beginning) % 4), dtype="<u4").tolist() + [0]
    own = texts.words(place)
    words: list = [shared[i] if i < first else 0 for i in range(16)]
    out = np.empty(texts.n, dtype=np.uint32)
    for at in range(0, texts.n, CHUNK):
        part = own[:, at : at + CHUNK]
        words[first : first + len(part)] = part
        if place:
            words[first] = part[0] | _number(shared[first])
        words[14] = texts.bits(at, len(beginning))
        out[at : at + CHUNK] = _block(words, first, part.shape[1])
    return out.byteswap()


def _begin(words: list, steps: int) -> tuple:
    """The state after some steps of the first turn, of which parts may still be numbers."""
    a, b, c, d = _START
    for i in range(steps):
        parts = [a, d ^ (b & (c ^ d)), _K[i], words[i]]
        number = sum(p for p in parts if isinstance(p, int)) & _MASK
        arrays = [p for p in parts if not isinstance(p, int)]
        if arrays:
            x = arrays[0] + _number(number)
            for p in arrays[1:]:
                np.add(x, p, out=x)
            x = (x << _LEFT[i]) | (x >> _RIGHT[i])
            np.add(x, _number(b) if isinstance(b, int) else b, out=x)
        else:
            x = (b + (number << _S[i] | number >> (32 - _S[i]))) & _MASK
        a, b, c, d = d, x, b, c
    return a, b, c, d


def _block(words: list, first: int, n: int) -> np.ndarray:
    """first: the number of words before the first that is an array."""
    begun = min(first + 4, 16)
    a, b, c, d = (np.full(n, x, dtype=np.uint32) if isinstance(x, int) else x for x in _begin(words, begun))
    f, bc = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    add, xor, both, either, left, right = np.add, np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.left_shift, np.right_shift
    for i in range(begun, 61):
        if i < 16:
            xor(c, d, f), both(f, b, f), xor(f, d, f)
        elif i < 32:
            xor(b, c, f), both(f, d, f), xor(f, c, f)
        elif i >= 48:
            np.invert(d, f), either(f, b, f), xor(f, c, f)
        elif i % 2 == 0:
            xor(b, c, bc), xor(bc, d, f)
        else:
            xor(bc, b, f)  # the step before had this step's c and d as its b and c
        add(a, f, a)
        word = words[_WORD[i]]
        if isinstance(word, int):
            add(a, _number((_K[i] + word) & _MASK), a)
        else:
            add(a, _K_NUMBER[i], a), add(a, word, a)
        left(a, _LEFT[i], f), right(a, _RIGHT[i], a), either(a, f, a), add(a, b, a)
        a, b, c, d = d, a, b, c
    return b + _number(_START[0])
