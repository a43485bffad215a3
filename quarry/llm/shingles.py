"""Hashes of words and of word shingles, whole batches of texts at a time.

Words are `[^\\x20\\x09-\\x0D]+` over UTF-8 bytes with A-Z lower-cased.  A word's
hash is a polynomial over its bytes modulo 2**64, taken from prefix sums, then
mixed; so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes of text that are hashed at once; a longer text is cut between words.
CHUNK = 1 << 20
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_random = np.random.default_rng(20240229)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]  # A-Z count as a-z
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2**64 for i below n at least."""
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            factors = np.full(n, base, dtype=np.uint64)
            factors[0] = 1
            _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    edge = np.diff(np.concatenate(([True], blank[data], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def hashes_of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(max(len(data) + 1, CHUNK + 1))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mixed((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0xC2B2AE3D27D4EB4F))


def chunks(text: bytes, blank: np.ndarray) -> Iterator[bytes]:
    """``text`` in parts of about CHUNK bytes, cut between words."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and not blank[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def word_hashes(texts: Sequence[bytes], blank: np.ndarray = BLANK) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; ``blank`` tells the bytes between words."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        if held and size + len(text) > CHUNK:
            yield from _hashed_together(held, blank)
            held, size = [], 0
        if len(text) > CHUNK:
            parts = [_hashed_together([c], blank) for c in chunks(text, blank)]
            yield np.concatenate([p[0] for p in parts])
        else:
            held.append(text)
            size += len(text) + 1
    if held:
        yield from _hashed_together(held, blank)


def _hashed_together(texts: list[bytes], blank: np.ndarray) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    starts, ends = word_spans(data, blank)
    found = hashes_of_spans(data, starts, ends)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    cuts = np.searchsorted(starts, at)
    return [found[cuts[i] : cuts[i + 1]] for i in range(len(texts))]


def shingle_factors(width: int) -> np.ndarray:
    return np.random.default_rng(77).integers(1, 1 << 63, width + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles; of fewer words, the whole sequence is one."""
    n = len(words)
    if n == 0:
        return words
    factors = shingle_factors(width) if width != 5 else FIVE
    span = min(n, width)
    total = np.full(n - span + 1, span * int(factors[width]) % (1 << 64), dtype=np.uint64)
    for k in range(span):
        total += words[k : n - span + 1 + k] * factors[k]
    return np.unique(mixed(total))


FIVE = shingle_factors(5)
