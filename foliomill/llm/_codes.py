"""Text as arrays of code points: whole batches are handled by numpy, not char by char."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Odd multiplier of the polynomial hashes (arithmetic is modulo 2**64).
BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Joins the texts of a chunk; a noncharacter, so it stands in no valid text.
SEP = "\uffff"


def chunks(lengths: Sequence[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to about ``most``; a longer text is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(lengths):
        yield start, len(lengths)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined(texts: list[str]) -> str:
    """The texts joined by SEP; a SEP inside a text becomes a blank."""
    whole = SEP.join(texts)
    if whole.count(SEP) != len(texts) - 1:
        whole = SEP.join(t.replace(SEP, " ") for t in texts)
    return whole


_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64, or their inverses."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _INVERSE if inverse else BASE, np.uint64)
        steps[0] = 1
        have = _powers[inverse] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums S with S[i] = sum of values[j] * BASE**j for j < i."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end], equal for equal content wherever it stands."""
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start])


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values."""
    n = len(sums) - k
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[k:] - sums[:n]) * powers(len(sums), inverse=True)[:n])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in about log2(w) passes."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    have, low = 1, values
    while have * 2 <= w:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:n], low[w - have : w - have + n]) if have < w else low[:n]


def winnow(hashes: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
    """Positions of the leftmost minimum of each window of ``w`` hashes.

    ``valid[i]`` tells whether the window that starts at i may be used (lies
    within one text).  Position i < 2**21 is kept in the low bits of the key.
    """
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = np.uint64((1 << max(21, int(len(hashes)).bit_length())) - 1)
    key = (hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64)
    low = sliding_min(key, w)[valid[:n]] & bits
    if not len(low):
        return np.zeros(0, np.int64)
    low = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return np.unique(low).astype(np.int64)


@lru_cache(1)
def word_chars() -> np.ndarray:
    """Whether a code point is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
