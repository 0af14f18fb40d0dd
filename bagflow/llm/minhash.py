"""Kernels of operator 2: shingle sets, one-permutation signatures with optimal densification, and bands."""

from __future__ import annotations

import hashlib

import numpy as np

from bagflow.llm.common import LOWER, mix, span_hashes, words

#: Words of a shingle; bins of a signature; bins of a band.
SHINGLE, BINS, ROWS = 5, 128, 4
BANDS = BINS // ROWS

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, and the bounds of each text's.

    Words are lower-cased A-Z; a text of fewer words than a shingle is one shingle, a text without words has none."""
    body = LOWER[body]
    starts, ends, row = words(body, bounds)
    hashes = span_hashes(body, starts, ends)
    texts = len(bounds) - 1
    cuts = np.searchsorted(row, np.arange(texts + 1))
    n = np.diff(cuts)
    window = np.zeros(0, np.uint64)
    if len(hashes) >= SHINGLE:
        window = hashes[: len(hashes) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            window *= _MULTIPLIER
            window += hashes[k : len(hashes) - SHINGLE + 1 + k]
        window = mix(window)
    sets, sizes = [], np.zeros(texts, np.int64)
    for k in range(texts):
        if n[k] >= SHINGLE:
            values = np.sort(window[cuts[k] : cuts[k + 1] - SHINGLE + 1])
            fresh = np.empty(len(values), bool)
            fresh[0] = True
            np.not_equal(values[1:], values[:-1], out=fresh[1:])
            values = values[fresh]
        elif n[k]:
            values = np.zeros(1, np.uint64)
            for h in hashes[cuts[k] : cuts[k + 1]]:
                values = values * _MULTIPLIER + h
            values = mix(values + np.uint64(n[k]))
        else:
            continue
        sets.append(values)
        sizes[k] = len(values)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _donors(tries: int = 4096) -> np.ndarray:
    """The bins that an empty bin asks, in order; the same for every set, so equal bins ask alike."""
    seed = np.arange(tries * BINS, dtype=np.uint64).reshape(tries, BINS) + np.uint64(0x5851F42D4C957F2D)
    return (mix(seed) >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


DONORS = _donors()


def signatures(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One-permutation signatures, a row per set: the least hash of each bin, empty bins filled by optimal densification.

    The hash's top bits are its bin, so in a sorted set each bin's least hash comes first. A row of an empty set is all 0."""
    sets = len(cuts) - 1
    row = np.repeat(np.arange(sets), np.diff(cuts))
    bin_of = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    place = row * BINS + bin_of
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    out = np.zeros(sets * BINS, np.uint64)
    full = np.zeros(sets * BINS, bool)
    out[place[first]] = hashes[first]
    full[place[first]] = True
    out, full = out.reshape(sets, BINS), full.reshape(sets, BINS)
    rows, bins = np.nonzero(~full & full.any(1, keepdims=True))
    for ask in DONORS:
        if not len(rows):
            break
        donor = ask[bins]
        found = full[rows, donor]
        out[rows[found], bins[found]] = out[rows[found], donor[found]]
        rows, bins = rows[~found], bins[~found]
    if len(rows):  # practically never: the first full bin
        out[rows, bins] = out[rows, full[rows].argmax(1)]
    return out


def short(signature: np.ndarray) -> np.ndarray:
    """16 bits of each bin: what is stored of a signature."""
    return (mix(signature) & np.uint64(0xFFFF)).astype(np.uint16)


def bands(stored: np.ndarray) -> np.ndarray:
    """A 64-bit code of each band of stored signatures: its ROWS bins, with the band's number mixed in."""
    return mix(np.ascontiguousarray(stored).view(np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MULTIPLIER)


def set_key(values: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()
