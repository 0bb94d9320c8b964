"""64-bit hashing of words and shingles with numpy, equal on every machine."""

import numpy as np
import xxhash

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
CACHE_WORDS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def seeds(count: int, salt: int) -> np.ndarray:
    return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(salt << 20)) * _GOLDEN)


def ascii_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lowered, nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHasher:
    """Hashes words; remembers frequent ones within a bounded table."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word runs; a shorter text is one run."""
    n = len(word_hashes)
    if n == 0:
        return word_hashes
    width = min(width, n)
    h = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        h = mix((h + word_hashes[j:n - width + 1 + j]) * _GOLDEN + np.uint64(j + 1))
    return np.unique(h)
