"""Hashes of words and word n-grams of many texts at once, in numpy.

A text is lower-cased, ASCII punctuation becomes a space if asked, and words are what lies between
ASCII white space. A word's hash is a polynomial in its bytes modulo 2^64, read off a running sum,
and mixed; it depends on the word alone, so it is the same on every machine.
"""

from __future__ import annotations

import numpy as np

# The multipliers and shifts of the splitmix64 finaliser and its increment.
_M1, _M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D  # an odd multiplier

_SPACES = bytes(range(9, 14)) + b" "
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(_SPACES)] = True
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
NO_PUNCTUATION = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(kind: str, n: int) -> np.ndarray:
    table = _powers[kind]
    if len(table) < n:
        size = max(n, 2 * len(table), 1 << 16)
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        table = _powers[kind] = np.multiply.accumulate(factors)
    return table[:n]


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte array with a newline after each, and where each begins (one more entry: the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return data, np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: each word's hash, each word's first byte, and where each text's words begin (one more: the end)."""
    solid = ~IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    begin, end = edges[::2], edges[1::2]
    n = len(data)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("up", n))])
    h = (sums[end] - sums[begin]) * _power_table("down", n + 1)[begin]
    return mix(h + (end - begin).astype(np.uint64) * GOLDEN), begin, np.searchsorted(begin, starts)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on; the last n - 1 entries mean nothing."""
    out = h.copy()
    for k in range(1, min(n, len(h))):
        out[: len(h) - k] = mix(out[: len(h) - k] * GOLDEN + h[k:])
    return out


def shingles(texts: list[str], n: int = 5, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, and where each text's begin. A text with 1 to n - 1 words has one shingle of them all."""
    lowered = [t.lower().encode() for t in texts]
    data, starts = join(lowered if punctuation else [t.translate(NO_PUNCTUATION) for t in lowered])
    h, _, at = words(data, starts)
    counts = np.diff(at)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(upto[-1]) + np.repeat(at[:-1] - upto[:-1], sizes)
    out = ngrams(h, n)[index] if len(h) else np.zeros(0, np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        out[upto[i]] = np.uint64(0)
        for x in h[at[i] : at[i + 1]]:
            out[upto[i] : upto[i] + 1] = mix(out[upto[i] : upto[i] + 1] * GOLDEN + x)
    return out, upto


# Byte classes for tokens: white space, punctuation, and all else (letters, digits, bytes over 127).
_CLASS = np.full(256, 2, np.int8)
_CLASS[list(PUNCTUATION)] = 1
_CLASS[:33] = 0
_CLASS[127] = 0
_UPPER, _LOWER, _DIGIT = (np.array([f(chr(c)) and c < 128 for c in range(256)]) for f in (str.isupper, str.islower, str.isdigit))


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts: hashes of words and punctuation runs, hashes of their shapes, and where each text's begin.

    A shape is a word's case, whether it holds digits and whether it is the token before it once more, or the
    punctuation itself.
    """
    kind = _CLASS[data]
    change = np.flatnonzero(np.diff(np.concatenate([np.zeros(1, np.int8), kind, np.zeros(1, np.int8)])))
    begin, end = change[:-1], change[1:]
    solid = kind[begin] > 0
    begin, end = begin[solid], end[solid]
    n = len(data)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power_table("up", n))])
    h = mix((sums[end] - sums[begin]) * _power_table("down", n + 1)[begin] + (end - begin).astype(np.uint64) * GOLDEN)
    count = lambda flags: (c := np.concatenate([[0], np.cumsum(flags[data])]))[end] - c[begin]
    upper, lower, digit = count(_UPPER), count(_LOWER), count(_DIGIT)
    first = np.searchsorted(begin, starts)
    again = np.concatenate([np.zeros(1, bool), h[1:] == h[:-1]])[: len(h)]
    again[first[first < len(h)]] = False  # a text's first token has none before it
    shape = (upper > 0) * 1 + (upper > 1) * 2 + (lower > 0) * 4 + (digit > 0) * 8 + again * 16 + 32
    return h, np.where(kind[begin] == 1, h, mix(shape.astype(np.uint64) * GOLDEN)), first
