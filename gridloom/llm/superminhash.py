"""SuperMinHash signatures of many sets at a time.

Every element has a random permutation of the ``m`` places and visits them in that order, with the value
(step number + a random fraction); a place keeps the least value. The ranks of one element at two places are
correlated, they never coincide, and so the estimate of the similarity has a lower variance than with
independent hash functions. Values of step j are at least j, so once a set has filled all its places after a
step, no later step can change it: large sets need one or two steps, not ``m``.
"""

from __future__ import annotations

import numpy as np

from gridloom.llm.shingles import mix

_GOLDEN = 0x9E3779B97F4A7C15
#: Elements that are worked on at once; bounds the memory of the permutations.
AT_ONCE = 1 << 18
EMPTY = np.uint64((1 << 64) - 1)


def _step(elements: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For step j: which of the places still to come is swapped in (j to m - 1), and the value j + fraction in fixed point."""
    random = mix(elements + np.uint64(((j + 1) * _GOLDEN) & ((1 << 64) - 1)))
    place = (((random >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64) + j
    return place, (random & np.uint64(0xFFFFFFFF)) | np.uint64(j << 32)


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """A row of ``m`` values for each set of distinct 64-bit hashes; the row of an empty set stays at EMPTY."""
    out = np.full((len(sets), m), EMPTY, dtype=np.uint64)
    begin, count = 0, 0
    for i, s in enumerate(sets):
        if count and count + len(s) > AT_ONCE:
            _fill(sets[begin:i], out[begin:i])
            begin, count = i, 0
        count += len(s)
    _fill(sets[begin:], out[begin:])
    return out


def _fill(sets: list[np.ndarray], out: np.ndarray) -> None:
    """Parts of a set that is larger than AT_ONCE are folded in one after the other."""
    if len(sets) == 1 and len(sets[0]) > AT_ONCE:
        for i in range(0, len(sets[0]), AT_ONCE):
            part = np.full_like(out, EMPTY)
            _fill([sets[0][i : i + AT_ONCE]], part)
            np.minimum(out, part, out=out)
        return
    m = out.shape[1]
    elements = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = out.reshape(-1)
    place, value = _step(elements, 0, m)
    np.minimum.at(flat, owner * m + place, value)
    open_sets = (out == EMPTY).any(axis=1)
    at = np.flatnonzero(open_sets[owner])
    if not len(at):
        return
    elements, owner, place = elements[at], owner[at], place[at]
    order = np.tile(np.arange(m, dtype=np.uint16), (len(at), 1))
    row = np.arange(len(at))
    order[row, place] = 0
    for j in range(1, m):
        place, value = _step(elements, j, m)
        target = order[row, place]
        order[row, place] = order[row, j]
        np.minimum.at(flat, owner * m + target, value)
        open_sets = (out == EMPTY).any(axis=1)
        stay = open_sets[owner]
        if not stay.all():
            at = np.flatnonzero(stay)
            if not len(at):
                return
            elements, owner, order = elements[at], owner[at], order[at]
            row = np.arange(len(at))


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of ``rows`` places: shape (sets, bands), signed."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.zeros(parts.shape[:2], dtype=np.uint64)
    for k in range(rows):
        key = mix(key + parts[:, :, k])
    return key.view(np.int64)
