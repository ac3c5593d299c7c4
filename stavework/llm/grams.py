"""Hashes of rolling word k-grams of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import mix64

_P = np.uint64(0x5851F42D4C957F2D | 1)


def _wrapping_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    inverse = pow(int(_P), -1, 1 << 64)
    up, down = np.full(n, _P, np.uint64), np.full(n, np.uint64(inverse), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


#: Bytes as words see them; 32 parts words. First: ASCII letters and digits and all bytes of longer characters, A-Z as a-z.
#: Second: all bytes but white space.
FOLDED_ASCII = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() and b < 128 or b > 127 else 32 for b in range(256))

PLAIN = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def word_grams(data: bytes, bounds: np.ndarray, fold: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end in data (bounds: their offsets): first byte and length of each word, the text it is in, and the
    hash of the k-gram that starts at it (0 where the text has too few words left)."""
    folded = np.frombuffer(data.translate(fold), np.uint8)
    inside = folded != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = bounds[:-1][bounds[:-1] < len(folded)]
    begins[cut] = inside[cut]
    finishes = inside.copy()
    finishes[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    up, down = _wrapping_powers(len(folded) + 1)
    sums = np.zeros(len(folded) + 1, np.uint64)
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    word = mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    text = np.searchsorted(bounds, start, "right") - 1
    gram = np.zeros(len(word), np.uint64)
    n = len(word) - k + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = mix64(h * _P + word[i : i + n])
        gram[:n] = np.where(text[:n] == text[k - 1 :], np.where(h == 0, np.uint64(1), h), np.uint64(0))
    return start, end - start, text, gram
