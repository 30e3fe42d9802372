"""Words as 64-bit numbers, their shingles, and the mixing of numbers: shared by the dedup operators."""

from __future__ import annotations

import numpy as np
import xxhash

from isobar.llm.base import FORGET

#: Words that a worker remembers.
REMEMBERED = 200_000


class WordNumbers(dict):
    """64-bit numbers by word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


NUMBERS = WordNumbers()
FORGET.append(NUMBERS.clear)


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words parted by space and the controls from tab to carriage return; lower changes A-Z alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def numbers(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(NUMBERS.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(of: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k of the numbers; their order counts."""
    n = len(of) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = mixed(out + of[j : j + n] + np.uint64(j)) if j else mixed(of[:n])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text, ascending. Fewer words are one shingle; no words, none."""
    of = numbers(words(text, lower=True))
    if not len(of):
        return of
    return np.unique(grams(of, min(k, len(of))) ^ np.uint64(0 if len(of) >= k else len(of)))
