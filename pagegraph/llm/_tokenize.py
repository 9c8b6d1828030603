"""Ids of many texts by the tokenizers library, with the library asked only once for each distinct piece.

A byte-level BPE splits a text into pieces by a fixed pattern and encodes each piece by itself. The pieces of a
batch are found in numpy; each distinct one goes through the library once, and its ids are kept for the next
batches. What kind of character (letter, number, blank, other) the library takes each one for is asked of the
library too. Texts with characters that were not asked about go through the library whole, as do all texts if
the tokenizer is of another kind.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from pagegraph.llm._bytes import buffer_of, ragged, slices, xxh64

#: Code points below it are sorted into kinds; they hold the Latin, Greek, Cyrillic and other alphabets, and punctuation.
KNOWN = 0x2100
#: Bytes of pieces kept; the store starts anew beyond it, so memory stays bounded.
STORE_BYTES = 24 << 20
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)


class FastEncoder:
    """encode(texts) gives the ids of all texts on end, and the number of ids of each."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        self.pieces = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("add_prefix_space") is False and pre.get("use_regex", True) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        if self.pieces:
            self._kinds()
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _kinds(self) -> None:
        split = self.library.pre_tokenizer.pre_tokenize_str
        # The letter that stands for each byte: printable ones stand for themselves, the others follow from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        spare = iter(range(256, 512))
        self.letters = "".join(chr(b if b in plain else next(spare)) for b in range(256))
        self.kind = np.full(KNOWN, _BLANK, np.uint8)
        for c in range(KNOWN):
            for lead, kind in (("a", _LETTER), ("1", _NUMBER), ("!", _OTHER)):
                if len(split(lead + chr(c))) == 1:
                    self.kind[c] = kind
                    break

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """First row and end of each slice of about a megabyte, ids of its texts on end, and how many each has; null is empty."""
        for at, to in slices(texts):
            yield at, to, *self._slice(texts.slice(at, to - at))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(x.ids, np.uint32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.pieces:
            return self._whole([x or "" for x in texts.to_pylist()])
        buf, offs = buffer_of(texts)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        point, unknown = self._points(buf, lead)
        first = np.searchsorted(lead, offs)
        if unknown.any():
            return self._mixed(texts, np.add.reduceat(np.append(unknown, False), first[:-1]) * (np.diff(first) > 0) > 0)
        starts = lead[self._starts(point, first)]
        ends = np.append(starts[1:], len(buf))
        piece = self._lookup(buf, starts, ends)
        count = self.count[piece]
        total = np.concatenate([[0], np.cumsum(count)])
        upto = total[np.searchsorted(starts, offs)]
        return self.ids[ragged(self.start[piece], count)], np.diff(upto)

    def _mixed(self, texts: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with unknown characters whole, the others by pieces."""
        counts = np.zeros(len(texts), np.int64)
        parts = []
        for flag in (False, True):
            rows = np.flatnonzero(whole == flag)
            if len(rows):
                some = texts.take(pa.array(rows))
                got, n = self._whole(some.to_pylist()) if flag else self._slice(some)
                counts[rows] = n
                parts.append((rows, got, n))
        place = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        for rows, got, n in parts:
            ids[ragged(place[rows], n)] = got
        return ids, counts

    @staticmethod
    def _points(buf: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points, and whether they are past the known ones."""
        b = buf[lead].astype(np.int32)
        tail = np.concatenate([buf, np.zeros(3, np.uint8)])
        point = b.copy()
        two = np.flatnonzero((b >= 0xC0) & (b < 0xE0))
        point[two] = ((b[two] & 31) << 6) | (tail[lead[two] + 1] & 63)
        three = np.flatnonzero((b >= 0xE0) & (b < 0xF0))
        point[three] = ((b[three] & 15) << 12) | ((tail[lead[three] + 1] & 63).astype(np.int32) << 6) | (tail[lead[three] + 2] & 63)
        point[b >= 0xF0] = KNOWN
        return point, point >= KNOWN

    def _starts(self, point: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Indexes of the characters that begin a piece; first: each text's first character, and the end."""
        n = len(point)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.kind[point]
        fresh = np.zeros(n + 1, bool)
        fresh[first] = True
        begin = fresh.copy()
        begin[1:n] |= kind[1:] != kind[:-1]
        begin[n] = True
        # The last blank before something solid stands apart, and a space there belongs to what follows it.
        last = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~fresh[1:n])
        begin[last] = True
        begin[last[point[last] == 32] + 1] = False
        # An apostrophe that begins a piece takes one of these endings with it.
        mark = np.flatnonzero((point == 39) & begin[:n])
        padded = np.concatenate([point, np.zeros(3, point.dtype)])
        ended = np.concatenate([fresh, np.ones(3, bool)])
        a, b = padded[mark + 1], padded[mark + 2]
        alone = ~ended[mark + 1]
        one = alone & np.isin(a, [ord(x) for x in "stmd"])
        two = alone & ~ended[mark + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for where, size in ((mark[one], 2), (mark[two], 3)):
            begin[where + 1] = False
            after = where + size
            after = after[(after < n)]
            begin[after[kind[after] == _LETTER]] = True
        return np.flatnonzero(begin[:n])

    def _lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each piece in the store, which gets the new ones."""
        keys, which, back = np.unique(xxh64(buf, starts, ends), return_index=True, return_inverse=True)
        if 3 * self.keys.nbytes + self.ids.nbytes > STORE_BYTES:
            self._clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            data, bpe = buf.tobytes(), self.library.model.tokenize
            found = [[t.id for t in bpe(codecs.charmap_decode(data[starts[i] : ends[i]], "strict", self.letters)[0])] for i in which[new].tolist()]
            n = np.array([len(x) for x in found], np.int64)
            got = np.fromiter((i for x in found for i in x), np.uint32, int(n.sum()))
            order = np.argsort(np.concatenate([self.keys, keys[new]]), kind="stable")
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])[order]
            self.count = np.concatenate([self.count, n])[order]
            self.keys = np.concatenate([self.keys, keys[new]])[order]
            self.ids = np.concatenate([self.ids, got])
            at = np.searchsorted(self.keys, keys)
        return at[back]
