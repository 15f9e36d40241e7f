"""64-bit hashes of word shingles for whole Arrow batches, by array arithmetic.

Words are the runs of bytes other than ASCII white space, with A-Z in lower case. A word's hash is its polynomial in an
odd base modulo 2**64, taken from prefix sums; a shingle's hash mixes those of its words. A text with fewer words than
a shingle has, but with some, gives its whole sequence as one shingle; a text without words (or null) gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
#: Bytes that are hashed at a time.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TURN = [np.uint64((0xD6E8FEB86659FD93 * (2 * k + 1) ** 7) & (2**64 - 1) | 1) for k in range(WORDS + 1)]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _powers:
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        tables = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > PIECE:
            return tables
        _powers[size] = tables
    return _powers[size]


def _hash_piece(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of data; a word also ends where one of the positions firsts begins."""
    word = ~_SPACE[data]
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cut = np.zeros(len(data) + 1, bool)
    cut[firsts] = True
    before = np.concatenate(([False], word[:-1]))
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    up, down = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, in order, and how many of them each text has."""
    large = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    hashes, counts = [], np.zeros(len(texts), np.int64)
    nulls = np.asarray(texts.is_null()) if texts.null_count else None
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        at, end = int(offsets[row]), int(offsets[last])
        while at < end or row < last:
            stop = end
            if stop - at > 2 * PIECE:  # one long text: cut it at white space
                stop = at + PIECE
                while stop < end and not _SPACE[data[stop]]:
                    stop += 1
            firsts = offsets[row:last] - at
            found, starts = _hash_piece(data[at:stop], firsts[(firsts >= 0) & (firsts <= stop - at)])
            hashes.append(found)
            np.add.at(counts, row - 1 + np.searchsorted(offsets[row:last], starts + at, "right"), 1)
            at = stop
            if at >= end:
                break
        row = last
    if nulls is not None and nulls.any():
        keep = np.repeat(~nulls, counts)
        hashes, counts = [np.concatenate(hashes)[keep] if hashes else np.zeros(0, np.uint64)], np.where(nulls, 0, counts)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingles_of(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of one text's word hashes, in order, repeats included."""
    n = len(words)
    if not n:
        return words
    take = min(n, size)
    total = np.full(n - take + 1, np.uint64(take))
    for k in range(take):
        total = mixed(total * _TURN[0] + words[k : n - take + 1 + k])
    return total


def shingle_sets(texts: pa.Array, size: int = WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its word hashes and its distinct shingle hashes, ascending."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    for start, end in zip(ends - counts, ends, strict=True):
        own = words[start:end]
        found = shingles_of(own, size)
        found.sort() if len(found) > 1 else None
        yield own, (found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found)
