"""Counting quotient filters over n-grams packed in at most 64 bits.

A key of ``bits`` bits goes through a permutation of all numbers of that many bits, which
can be undone, so equal spread costs nothing and loses nothing. The leading bits of the
permuted key are its quotient, all others its remainder; a filter holds, in order of the
permuted keys, how many keys each quotient has (in unary), the full remainders in whole
bytes (all first bytes, then all second ones, so that half-empty ones pack well), and a counter for each key: a byte, or an entry of a list where it is 255 or more.
So a filter is a compact lossless table of (key, count), and filters merge as sorted lists.
"""

from __future__ import annotations

import numpy as np

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def permute(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys of ``bits`` bits, spread evenly: multiplied by an odd number and folded, twice."""
    half, mask = np.uint64((bits + 1) // 2), _mask(bits)
    for odd in _ODD:
        keys = (keys * np.uint64(odd)) & mask
        keys = keys ^ (keys >> half)
    return keys


def restore(keys: np.ndarray, bits: int) -> np.ndarray:
    """The keys that ``permute`` has spread."""
    half, mask = np.uint64((bits + 1) // 2), _mask(bits)
    for odd in reversed(_ODD):
        keys = keys ^ (keys >> half)
        keys = (keys * np.uint64(pow(odd, -1, 1 << 64))) & mask
    return keys


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, sums of their counts, the place of each given key among them)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    heads = np.flatnonzero(first)
    places = np.empty(len(keys), np.int64)
    places[order] = np.cumsum(first) - 1
    if counts is None:
        sums = np.diff(np.append(heads, len(keys)))
    else:
        sums = np.add.reduceat(counts[order], heads) if len(heads) else np.zeros(0, np.int64)
    return ordered[heads], sums, places


def encode(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A filter of distinct keys of ``bits`` bits in ascending order, each with a count of 0 or more."""
    n = len(keys)
    quotient_bits = min(bits, max(0, n - 1).bit_length())
    rest = bits - quotient_bits
    quotients = keys >> np.uint64(rest) if rest < 64 else np.zeros(n, np.uint64)
    unary = np.zeros(n + (1 << quotient_bits), np.uint8)
    unary[np.arange(n) + quotients.astype(np.int64)] = 1
    remainders = (keys & _mask(rest)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :-(-rest // 8)].T
    large = counts[counts >= 255]
    return b"".join((np.array([n, quotient_bits, len(large)], "<u8").tobytes(), np.packbits(unary).tobytes(), remainders.tobytes(),
                     np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype("<u8").tobytes()))


def decode(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of a filter."""
    n, quotient_bits, n_large = np.frombuffer(data, "<u8", 3).tolist()
    rest = bits - quotient_bits
    width, slots, at = -(-rest // 8), n + (1 << quotient_bits), 24
    unary = np.unpackbits(np.frombuffer(data, np.uint8, -(-slots // 8), at), count=slots)
    at += -(-slots // 8)
    keys = np.zeros((n, 8), np.uint8)
    keys[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    keys = keys.view("<u8").reshape(n)
    at += n * width
    quotients = np.flatnonzero(unary) - np.arange(n)
    if rest < 64:
        keys = keys | (quotients.astype(np.uint64) << np.uint64(rest))
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<u8", n_large, at + n).astype(np.int64)
    return keys, counts
