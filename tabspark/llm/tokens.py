"""Words of a batch of texts as arrays: positions and 64-bit hashes, without a Python object per word.

Two word classes occur in the operators.  Bytes from 0x80 are parts of UTF-8 sequences and always belong
to words, so both classes can be decided byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_BASE, _BLOCK = 0x9E3779B97F4A7C15 | 1, 1 << 20
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    x = np.asarray(x, dtype=U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_class(allowed) -> np.ndarray:
    return np.array([allowed(b) for b in range(256)])


ALNUM = _byte_class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)  # A-Z are lower-cased first
SOLID = _byte_class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)])
_VALUE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))[_LOWER]
_POWER = np.ones(0, U)
_BACK = np.ones(0, U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWER, _BACK
    if len(_POWER) < n:
        n = max(n, _BLOCK + 1)
        for name, base in (("_POWER", _BASE), ("_BACK", _INVERSE)):
            a = np.full(n, base, U)
            a[0] = 1
            globals()[name] = np.multiply.accumulate(a)
    return _POWER, _BACK


@dataclass
class Words:
    start: np.ndarray  # byte position of each word
    end: np.ndarray
    hash: np.ndarray  # equal words (A-Z lower-cased) have equal hashes
    first: np.ndarray  # per text: index of its first word; one more entry than texts
    prefix: np.ndarray  # (lengths, words): hash of the first bytes of each word, 0 where the word is shorter

    def text_of(self) -> np.ndarray:
        """Per word: index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray, byte_class: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Maximal runs of bytes of a class inside each text, and hashes of their prefixes of some lengths."""
    n = len(data)
    inside = byte_class[data]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    out, heads = np.empty(len(start), U), np.zeros((len(prefixes), len(start)), U)
    i = 0
    while i < len(start):  # blocks of words: the running sums stay small even in a very long text
        j = max(i + 1, int(np.searchsorted(end, start[i] + _BLOCK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        power, back = _powers(hi - lo + 1)
        sums = np.empty(hi - lo + 1, U)
        sums[0] = 0
        np.cumsum(_VALUE[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(U) * U(0xA0761D6478BD642F))
        for row, n in zip(heads, prefixes):
            cut = np.minimum(s + n, hi - lo)
            row[i:j] = np.where(e - s >= n, mix((sums[cut] - sums[s]) * back[s] + U(n * 0xE7037ED1A0B428DB % (1 << 64))), U(0))
        i = j
    return Words(start, end, out, np.searchsorted(start, offsets), heads)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive words from each position (positions near the end wrap: mask them)."""
    if len(hashes) < k:
        return np.zeros(len(hashes), U)
    out = np.zeros(len(hashes) - k + 1, U)
    for j in range(k):
        out = out * U(0x9FB21C651E98DF25) + hashes[j : j + len(out)]
    return np.concatenate([mix(out), np.zeros(k - 1, U)])
