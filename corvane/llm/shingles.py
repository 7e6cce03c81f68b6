"""Word shingles of whole texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a task remembers with their hashes; beyond that it starts afresh.
CACHE_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n pseudorandom odd multipliers; the same for a seed on every machine."""
    return np.random.Generator(np.random.Philox(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Distinct word shingles of texts. A-Z count as a-z; words lie between space, tab, LF, VT, FF and CR."""

    def __init__(self, size: int = 5, seed: int = 11) -> None:
        self.size = size
        self.factor = odd_numbers(size, seed)
        self.hashes = _Hashes()

    def sets(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes; the whole sequence is one shingle if it is shorter than one."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.hashes) > CACHE_WORDS:
            self.hashes.clear()
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.size + 1)
        mixed = np.full(n, min(len(h), self.size), np.uint64)
        for i, f in enumerate(self.factor[: len(h)]):
            mixed += h[i : i + n] * f
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed.sort()
        return mixed[np.append(True, mixed[1:] != mixed[:-1])]
