"""Texts as byte arrays: words, shingles and XXH64 of many slices at once, in numpy.

A batch of Arrow texts becomes one buffer in which a line feed ends each text, so no word or shingle
crosses from one text into the next. White space is ASCII here, and no byte of a longer UTF-8 sequence is,
so bytes may be split where characters would be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: True for the bytes that separate words.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same, and all ASCII characters that are neither letters nor digits.
_MARK = np.zeros(256, bool)
_MARK[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end and their len + 1 offsets; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text stands alone. Keeps working memory flat."""
    _, offs = buffer_of(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        yield at, to
        at = to


@dataclass
class Words:
    """Words of some texts: ``data`` has them with one blank between; start and end index it."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    count: np.ndarray  # words of each text
    first: np.ndarray  # index of each text's first word


def words_of(texts: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """All words of all texts, in order; plain: ASCII punctuation separates them too."""
    ended = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string()))
    buf, offs = buffer_of(ended)
    solid = ~(_MARK if plain else _BLANK)[buf]
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    keep = solid | before
    place = np.cumsum(keep) - 1
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(~solid & before)
    data = buf[keep]
    data = _LOWER[data] if lower else data.copy()
    data[place[ends]] = 32
    upto = np.searchsorted(starts, offs)
    return Words(data, place[starts], place[ends], np.diff(upto), upto[:-1])


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end in ``words.data`` of each shingle, and the shingles of each text.

    A text of fewer words than ``size`` has one of all its words; a text without words has none.
    """
    count = np.where(words.count >= size, words.count - size + 1, np.minimum(words.count, 1))
    of = np.repeat(np.arange(len(count)), count)
    at = words.first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(at + size, words.first[of] + words.count[of]) - 1
    return words.start[at], words.end[last], count


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mix(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice ``data[start:end]`` as unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        return _xxh64(data, start.astype(np.int64), (end - start).astype(np.int64), np.uint64(seed))


def _xxh64(data: np.ndarray, at: np.ndarray, size: np.ndarray, seed: np.uint64) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    h = size.astype(np.uint64) + (seed + _P5)
    at, left = at.copy(), size.copy()
    long = np.flatnonzero(size >= 32)
    if len(long):
        one, two, three, fourth = (np.full(len(long), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1))
        live = np.arange(len(long))
        while len(live):
            p = at[long[live]]
            for acc, k in ((one, 0), (two, 8), (three, 16), (fourth, 24)):
                acc[live] = _mix(acc[live], eight[p + k])
            at[long[live]] += 32
            left[long[live]] -= 32
            live = live[left[long[live]] >= 32]
        g = _turn(one, 1) + _turn(two, 7) + _turn(three, 12) + _turn(fourth, 18)
        for acc in (one, two, three, fourth):
            g = (g ^ _mix(np.uint64(0), acc)) * _P1 + _P4
        h[long] = g + size[long].astype(np.uint64)
    live = np.flatnonzero(left >= 8)
    while len(live):
        p = at[live]
        h[live] = _turn(h[live] ^ _mix(np.uint64(0), eight[p]), 27) * _P1 + _P4
        at[live] += 8
        left[live] -= 8
        live = live[left[live] >= 8]
    live = np.flatnonzero(left >= 4)
    h[live] = _turn(h[live] ^ (four[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at[live] += 4
    left[live] -= 4
    live = np.flatnonzero(left >= 1)
    while len(live):
        h[live] = _turn(h[live] ^ (padded[at[live]].astype(np.uint64) * _P5), 11) * _P1
        at[live] += 1
        left[live] -= 1
        live = live[left[live] >= 1]
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    return h ^ (h >> np.uint64(32))


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    some = count > 0
    start, count = start[some], count[some]
    ends = np.cumsum(count)
    out[0] = start[0]
    out[ends[:-1]] = start[1:] - (start[:-1] + count[:-1] - 1)
    return np.cumsum(out)
