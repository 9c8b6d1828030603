"""Burrows-Wheeler transforms of shards of byte strings, and their merge by refining the interleave.

A string is taken as ``step`` chains of symbols, a symbol being the ``step`` bytes from some position on: chain r
has those at r, r + step, r + 2 step, ... Any ``step * depth`` bytes that begin at a position are then the first
``depth`` symbols of one suffix of one chain, and a merge has to look no deeper than ``depth`` rounds. Symbols are
named by the ranks of 64-bit hashes of their bytes; the order of suffixes is that of the names.

A shard's transform is, for its suffixes in order, the symbol before each (END at the start of a chain). The
merge knows nothing else of the shards. It keeps the interleave, which says of which shard each next suffix is,
at first with no symbol looked at. A round reads the transforms through the interleave and deals the entries out
by symbol, in order; what was ordered by k symbols is then ordered by k + 1 (J. Holt, L. McMillan, Merging of
multi-string BWTs with applications, 2014). Along with it goes the class of each entry, those with the same first
k symbols, whose borders are the places where the common prefix ends. After ``depth`` rounds, a class of several
entries is a repeated interval.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pagegraph.llm._bytes import ragged

STEP = 50
END = 0

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring windows from the hashes of each."""
    mixed = (left ^ (left >> np.uint64(31))) * _A + right * _B
    return mixed ^ (mixed >> np.uint64(29))


def window_hashes(data: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hash of the bytes from each position on, for each window size; shorter arrays where a window would not fit."""
    powers, width = {1: (data.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)}, 1
    while width * 2 <= max(sizes):
        last = powers[width]
        powers[width * 2] = _join(last[: max(0, len(last) - width)], last[width:])
        width *= 2
    out = []
    for size in sizes:
        whole, covered = None, 0
        for k in sorted(powers, reverse=True):
            if size & k:
                n = max(0, len(data) - covered - k + 1)
                whole = powers[k][:n] if whole is None else _join(whole[:n], powers[k][covered : covered + n])
                covered += k
        out.append(whole)
    return out


@dataclass
class Shard:
    """``before``: the symbol before each suffix, in order. ``place``: where in the data the suffix begins (-1: the empty one of a chain)."""

    before: np.ndarray
    place: np.ndarray


def _order(keys: np.ndarray, bits: int) -> np.ndarray:
    """A stable argsort of keys below 2 ** bits: place and key are sorted as one number, which is much faster."""
    width = max(1, int(len(keys)).bit_length())
    if bits + width > 63:
        return np.argsort(keys, kind="stable")
    packed = (keys.astype(np.int64) << width) | np.arange(len(keys))
    packed.sort()
    return packed & ((1 << width) - 1)


def _dense(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the keys, from 0, and the first place of each."""
    order = _order(keys, bits)
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(fresh) - 1
    return rank, order[fresh]


def named(hashes: np.ndarray, data: np.ndarray | None = None, size: int = STEP) -> np.ndarray:
    """Names of symbols: ranks of their hashes, from END + 1 on.

    With ``data``, the bytes of equal names are compared. Then as many bits of the hash as sort fast are tried first;
    where bytes differ, the whole hash, and where they still do, the bytes are the names.
    """
    if data is None or not len(hashes):
        return np.unique(hashes, return_inverse=True)[1].astype(np.int64) + END + 1
    windows = np.lib.stride_tricks.sliding_window_view(data, size)[: len(hashes)]

    def fits(name: np.ndarray, first: np.ndarray) -> bool:
        parts = range(0, len(hashes), 1 << 16)
        return not any((windows[at : at + (1 << 16)] != windows[first[name[at : at + (1 << 16)]]]).any() for at in parts)

    bits = 63 - max(1, int(len(hashes)).bit_length())
    name, first = _dense((hashes >> np.uint64(64 - bits)).astype(np.int64), bits)
    if not fits(name, first):
        _, first, name = np.unique(hashes, return_index=True, return_inverse=True)
        if not fits(name, first):
            name = np.unique(np.ascontiguousarray(windows).view(f"V{size}").ravel(), return_inverse=True)[1]
    return name.astype(np.int64) + END + 1


def shard_of(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, depth: int, step: int = STEP) -> Shard:
    """The transform of strings that begin at ``start`` and have ``length`` bytes; symbols: the name, an integer above END, at each position."""
    count = np.maximum(0, length - step + 1)  # positions of a string at which a symbol begins
    place = ragged(start, count)
    own = ragged(np.zeros(len(start), np.int64), count)
    size = np.repeat(count, count)
    name = symbols[place]
    # Ranks by 1, 2, 4, ... symbols; a suffix that has ended ranks below all others.
    rank, reach = name - END, 1
    index = np.arange(len(place))
    while reach < depth:
        inside = own + reach * step < size
        behind = np.where(inside, rank[np.minimum(index + reach * step, max(0, len(place) - 1))], 0)
        span = int(rank.max(initial=0)) + 1
        rank, reach = _dense(rank * span + behind, 2 * span.bit_length())[0] + 1, reach * 2
    order = _order(rank, int(rank.max(initial=0)).bit_length())
    before = np.where(own >= step, name[np.maximum(index - step, 0)], END)
    last = np.flatnonzero(own + step >= size)  # the symbol before each empty suffix, and each chain has one
    return Shard(np.concatenate([name[last], before[order]]), np.concatenate([np.full(len(last), -1), place[order]]))


def merged(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """place of each suffix of all shards in order of ``depth`` symbols, and its class."""
    # Small numbers, since what takes time is to move them about.
    interleave = np.concatenate([np.full(len(s.before), k, np.int16) for k, s in enumerate(shards)])
    befores = [s.before.astype(np.int32) for s in shards]
    bits = int(max(b.max(initial=0) for b in befores)).bit_length()
    group = np.zeros(len(interleave), np.int32)
    for _ in range(depth):
        before = np.empty(len(interleave), np.int32)
        for k, own in enumerate(befores):
            before[interleave == k] = own
        order = _order(before, bits)
        symbol, older = before[order], group[order]
        border = np.ones(len(order), bool)
        border[1:] = (symbol[1:] != symbol[:-1]) | (older[1:] != older[:-1]) | (symbol[1:] == END)
        group = np.cumsum(border, dtype=np.int32) - np.int32(1)
        interleave = interleave[order]
    place = np.empty(len(interleave), np.int64)
    for k, shard in enumerate(shards):
        place[interleave == k] = shard.place
    return place, group


def repeated(shards: list[Shard], depth: int) -> np.ndarray:
    """Places whose first ``depth`` symbols begin at another place too."""
    place, group = merged(shards, depth)
    many = np.bincount(group, minlength=1)[group] > 1
    return place[many & (place >= 0)]
