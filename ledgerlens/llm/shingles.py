"""Word shingles of whole texts as sorted arrays of 64-bit hashes, a batch at a time in numpy.

Words are runs of bytes other than ASCII white space, A-Z lowered. A text's set
holds its distinct ``SIZE``-word shingles; a shorter text has one shingle, its
whole sequence of words; a text without words, or null, has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SIZE = 5
#: Bytes of text hashed at a time; longer texts go in windows cut between words.
WINDOW = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_random = np.random.RandomState(20240229)
#: Values of bytes as they are; of words with A-Z lowered.
CASED = _random.randint(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
_BYTE = CASED[_LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = _random.randint(1, 1 << 63, SIZE, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_POWERS = np.ones(64, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.full(2 * n, _STEP, np.uint64)
        _POWERS[0] = 1
        np.multiply.accumulate(_POWERS, out=_POWERS)
    return _POWERS


_powers(64)
_POWERS = _powers(65)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the result depends on all bits of ``h``."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _word_hashes(data: np.ndarray, first: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and where each starts; words also end before ``first``."""
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    cut = first[(first > 0) & (first < len(data))]
    begin[cut] = inside[cut]
    at = np.flatnonzero(inside)
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    heads = np.flatnonzero(begin[at])
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at)) - np.repeat(heads, lengths)
    values = byte[data[at]] * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64)), starts


def words_of(data: np.ndarray, offsets: np.ndarray, byte: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of consecutive texts (bytes ``offsets[i]:offsets[i + 1]``) and their counts;
    ``byte``: values of the bytes, ``CASED`` to tell A-Z from a-z."""
    hashes, starts, at, end = [], [], int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + WINDOW)
        while to < end:  # not inside a word
            gap = np.flatnonzero(_SPACE[data[to:to + WINDOW]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(end, to + WINDOW)
        h, s = _word_hashes(data[at:to], offsets - at, byte)
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, counts = words_of(data, offsets)
    all_of = np.zeros(len(words), np.uint64)
    for k in range(SIZE):
        if len(words) > k:
            all_of[:len(words) - k] += words[k:] * _MULTIPLIERS[k]
    all_of = mix(all_of)
    ends = np.cumsum(counts)
    for begin, n in zip((ends - counts).tolist(), counts.tolist()):
        if n >= SIZE:
            own = np.sort(all_of[begin:begin + n - SIZE + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif n:
            yield mix(np.array([(words[begin:begin + n] * _MULTIPLIERS[:n]).sum() + np.uint64(n)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def pieces(texts: pa.Array, limit: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of row ranges of about ``limit`` bytes of a binary column."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        end = min(len(texts), max(end, begin + 1))
        yield begin, data, offsets[begin:end + 1]
        begin = end
