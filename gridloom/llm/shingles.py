"""Word shingles of whole texts as 64-bit hashes, worked out for many texts at a time with numpy.

Words are maximal runs of characters other than the ASCII white space 20 and 09-0D; A-Z are lower-cased.
A text's set holds its distinct shingles of ``n`` words; a text with fewer words has the whole sequence as
one shingle, a text without words has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Bytes that are hashed at once; longer texts are hashed in parts cut at white space.
PART_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Words of more bytes are hashed by a cryptographic hash: patterns that collide in both sums below take longer words.
LONG_WORD, _KEY = 32, b"words of texts"
#: A second modulus, a prime, and a base of it: what collides modulo 2**64 (texts with a recursive pattern do for any base) doesn't there.
_PRIME, _BASE_2 = (1 << 31) - 1, 1_234_567_891


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all of them."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _prime_powers(base: int, size: int) -> np.ndarray:
    """Powers 0 to ``size`` - 1 of ``base`` modulo the prime, doubled up."""
    out = np.ones(1, dtype=np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), _PRIME)) % np.uint64(_PRIME)])
    return out[:size]


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, ...]:
    """A value for each byte, and the powers of a base and of its inverse modulo 2**64 and modulo the prime."""
    size = PART_BYTES + (1 << 14)
    with np.errstate(over="ignore"):
        up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size, b, dtype=np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)), up, down, _prime_powers(_BASE_2, size + 1), _prime_powers(pow(_BASE_2, -1, _PRIME), size + 1)


def _hash_part(data: bytes) -> np.ndarray:
    """A hash for each word of ``data``, whose length the power tables cover."""
    values, up, down, up_2, down_2 = _powers()
    a = np.frombuffer(data, dtype=np.uint8)
    word = ~_SPACE[a]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(a) and word[0]:
        edge = np.concatenate([[0], edge])
    if len(a) and word[-1]:
        edge = np.concatenate([edge, [len(a)]])
    begin, end = edge[0::2], edge[1::2]
    total = np.empty(len(a) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(values[a] * up[: len(a)], out=total[1:])
    first = (total[end] - total[begin]) * down[begin]
    # Bytes times residues of 31 bits: the sum of all of a part stays below 2**60.
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up_2[: len(a)], out=total[1:])
    second = (total[end] - total[begin]) % np.uint64(_PRIME) * down_2[begin] % np.uint64(_PRIME)
    out = mix(mix(first + (end - begin).astype(np.uint64)) + second * np.uint64(_BASE))
    for i in np.flatnonzero(end - begin > LONG_WORD):
        out[i] = _hash_long_word(data[begin[i] : end[i]])[0]
    return out


def _parts(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        end = min(len(text), at + PART_BYTES)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def _hash_long_word(word: bytes) -> np.ndarray:
    """A word of more than ``LONG_WORD`` bytes."""
    return np.frombuffer(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), dtype="<u8").copy()


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word of one lower-cased text of any length."""
    out = []
    for part in _parts(text):
        if len(part) <= PART_BYTES + (1 << 14):
            out.append(_hash_part(part))
            continue
        for word in part.split():
            out.append(_hash_part(word) if len(word) <= LONG_WORD else _hash_long_word(word))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _chain(words: np.ndarray, n: int) -> np.ndarray:
    out = words[: len(words) - n + 1] + np.uint64(n)
    for k in range(1, n):
        out = out * _STEP + words[k : len(words) - n + 1 + k]
    return mix(out)


def shingle_sets(texts: list[str | None], n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, in order. Null counts as empty."""
    waiting, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if waiting and size + len(data) > PART_BYTES:
            yield from _sets(waiting, n)
            waiting, size = [], 0
        waiting.append(data)
        size += len(data) + 1
    yield from _sets(waiting, n)


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    if len(texts) == 1:
        hashes = word_hashes(texts[0])
        bounds = [0, len(hashes)]
    else:
        joined = b" ".join(texts)
        hashes = _hash_part(joined)
        is_word = ~_SPACE[np.frombuffer(joined, dtype=np.uint8)]
        starts = is_word.copy()
        starts[1:] &= ~is_word[:-1]
        before = np.concatenate([[0], np.cumsum(starts)])
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        bounds = [0, *before[ends].tolist()]
    chained = _chain(hashes, n) if len(hashes) >= n else hashes[:0]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= n:
            found = np.sort(chained[a : b - n + 1])
            first = np.ones(len(found), dtype=bool)
            np.not_equal(found[1:], found[:-1], out=first[1:])
            yield found[first]
        elif b > a:
            yield _chain(hashes[a:b], b - a)
        else:
            yield hashes[:0]
