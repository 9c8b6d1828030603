"""Benchmark decontamination: an inverted index of the test items, BM25 with block-max WAND, and overlap to verify.

The items are the indexed side, and every passage of every training document is a query against them. Items are
indexed by length, a class for each power of two. Passages of a class are windows of two strides, one stride apart,
where a stride is as long as the class's longest items may be, so an item that a document holds lies whole in one of
them, and one very long item does not make all passages long. An item is retrieved if the passage's BM25 score for
it reaches ``SHARE`` of the item's score for itself; impacts are divided by that bound, so it is 1 for all items.

A class has a posting list for each term, of items in ascending order with their impacts, cut into blocks of BLOCK
items with the largest impact of each. Block-max WAND is run for many passages at once. The terms of a passage are
taken in ascending order of their largest impact; where the sum first reaches 1 is the pivot, and an item with no
term from the pivot on can't reach the bound. So only blocks in the lists of those terms are looked at; of these only
the blocks in which the block maxima of all the passage's terms add up to 1 are opened, and only items of opened
blocks are scored. No item at the bound is lost by it.

Retrieved items are verified by word shingles: a share of ``OVERLAP`` of the item's shingles must be in the
passage, and of those of its question and of its answer ``PART_OVERLAP`` each. Where items come as one text, the
last third of the words counts as the answer. Words are lower-cased (A-Z) and parted by ASCII punctuation too.

Items are broadcast, up to ``ITEM_BYTES`` of text at a time, whose index takes at most about 16 times as much (and TABLE
numbers for each class); more of them are taken in several passes, each with the term statistics of its own items.

Edge cases: null or blank texts and items match nothing; an item of fewer words than a shingle is one shingle;
items with fewer than two shingles' words are question and answer in one; repeated rows each get their result;
an empty benchmark leaves all documents clean; other columns pass through ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm._bytes import Words, ragged, slices, words_of, xxh64
from pagegraph.llm._shared import given_back

K1, B = 1.2, 0.75
SHINGLE = 5
SHARE = 0.6
OVERLAP, PART_OVERLAP = 0.8, 0.5
BLOCK = 16
LEAST_STRIDE = 32
ITEM_BYTES = 4 << 20
#: Pairs of a block and a term of its passage that are looked up at once.
LOOKUPS = 1 << 21
#: Places of a direct table, at most.
TABLE = 1 << 20
#: Slack of the upper bounds for rounding.
SLACK = 1e-4


def _hashes(words: Words) -> np.ndarray:
    return xxh64(words.data, words.start, words.end)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` word hashes; none if there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            mixed = (mixed ^ words[k : k + n]) * np.uint64(0x9E3779B185EBCA87)
            mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class _Class:
    """Posting lists of the items of one stride, cut into blocks."""

    def __init__(self, stride: int, items: np.ndarray, n_terms: int, terms: np.ndarray, slot: np.ndarray, impact: np.ndarray):
        """items: the indexes of the class's items; terms (numbers below n_terms), slot, impact: one entry for each posting."""
        self.stride, self.items = stride, items
        self.blocks = -(-len(items) // BLOCK)
        known, term = np.unique(terms, return_inverse=True)
        self.own = np.full(n_terms, -1, np.int32)
        self.own[known] = np.arange(len(known))
        order = np.lexsort((slot, term))
        self.slot, self.impact = (slot[order] % BLOCK).astype(np.uint8), impact[order]
        code = term[order] * self.blocks + slot[order] // BLOCK
        self.begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        self.code = code[self.begin]  # term and block
        # A direct table of the blocks' places, where it is small; it gives what a search gives.
        self.table = None
        if len(known) * self.blocks <= TABLE:
            self.table = np.full(len(known) * self.blocks, -1, np.int32)
            self.table[self.code] = np.arange(len(self.code))
        self.block_most = np.maximum.reduceat(self.impact, self.begin)
        self.begin = np.append(self.begin, len(code))
        self.first = np.searchsorted(self.code, np.arange(len(known) + 1) * self.blocks)  # each term's first block
        self.most = np.maximum.reduceat(self.block_most, self.first[:-1])

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.own, self.slot, self.impact, self.begin, self.code, self.block_most, self.first, self.most, self.items, *([] if self.table is None else [self.table])))

    def retrieve(self, at: np.ndarray, passage: np.ndarray, n: int) -> Iterator[tuple[int, int, float]]:
        """passage, item and score of all that reach 1; at and passage: terms of the class, by number, and where they are."""
        # Repeated words only raise this sum, so it stays an upper bound.
        alive = np.bincount(passage, self.most[at], n)[passage] >= 1 - SLACK
        both = np.unique(passage[alive] * len(self.most) + at[alive])
        passage, at = both // len(self.most), both % len(self.most)
        order = np.lexsort((self.most[at], passage))
        passage, at = passage[order], at[order]
        begin = np.flatnonzero(np.append(True, passage[1:] != passage[:-1])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(at)))
        upto = np.cumsum(self.most[at], dtype=np.float64)
        before = np.repeat(upto[begin] - self.most[at][begin], size)
        essential = np.flatnonzero(upto - before >= 1 - SLACK)
        # The blocks of the terms from the pivot on.
        which = np.repeat(np.arange(len(begin)), size)[essential]
        count = self.first[at[essential] + 1] - self.first[at[essential]]
        block = self.code[ragged(self.first[at[essential]], count)] % self.blocks
        looked = np.unique(np.repeat(which, count) * self.blocks + block)
        step = max(1, LOOKUPS // max(1, int(size.max(initial=1))))
        for k in range(0, len(looked), step):
            yield from self._scored(looked[k : k + step], passage, at, begin, size)

    def _place(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Where a term's block stands in the lists, -1 if it has no posting there."""
        code = term * self.blocks + block
        if self.table is not None:
            return self.table[code]
        place = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[place] == code, place, -1)

    def _scored(self, looked: np.ndarray, passage: np.ndarray, at: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, float]]:
        which, block = looked // self.blocks, looked % self.blocks
        rows = ragged(begin[which], size[which])
        of = np.repeat(np.arange(len(looked)), size[which])
        place = self._place(at[rows], block[of])
        there = place >= 0
        of, place = of[there], place[there]
        opened = np.bincount(of, self.block_most[place], len(looked)) >= 1 - SLACK
        of, place = of[opened[of]], place[opened[of]]
        count = self.begin[place + 1] - self.begin[place]
        posting = ragged(self.begin[place], count)
        keys, back = np.unique(np.repeat(of, count) * BLOCK + self.slot[posting], return_inverse=True)
        score = np.bincount(back, self.impact[posting].astype(np.float64), len(keys))
        for j in np.flatnonzero(score >= 1).tolist():
            k, slot = divmod(int(keys[j]), BLOCK)
            yield int(passage[begin[which[k]]]), int(self.items[block[k] * BLOCK + slot]), float(score[j])


class ItemIndex:
    """Test items: ids, texts of questions and of answers (None: the answer is the last third of the text)."""

    def __init__(self, ids: list[int], questions: list[str | None], answers: list[str | None] | None = None, share: float = SHARE):
        answers = answers or [None] * len(ids)
        words = words_of(pa.array([f"{q or ''}\n{a or ''}" for q, a in zip(questions, answers, strict=True)], pa.string()), lower=True, plain=True)
        ahead = words_of(pa.array([q or "" for q in questions], pa.string()), lower=True, plain=True).count
        hashes = _hashes(words)
        self.ids = ids
        self.sets: list[tuple[tuple[int, np.ndarray], ...]] = []
        for i, (first, n) in enumerate(zip(words.first.tolist(), words.count.tolist(), strict=True)):
            own = hashes[first : first + n]
            cut = int(ahead[i]) if answers[i] is not None else n - n // 3
            parts = (own, own[:cut], own[cut:]) if min(cut, n - cut) > 0 and n >= 2 * SHINGLE else (own, own, own)
            self.sets.append(tuple((min(SHINGLE, len(p)), shingle_set(p, min(SHINGLE, len(p)))) for p in parts))
        item = np.repeat(np.arange(len(ids)), words.count)
        terms, term = np.unique(hashes, return_inverse=True)
        pairs, tf = np.unique(item * max(1, len(terms)) + term, return_counts=True)
        item, term = pairs // max(1, len(terms)), pairs % max(1, len(terms))
        df = np.bincount(term, minlength=len(terms))
        n = int((words.count > 0).sum())
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        length = words.count / max(1e-9, words.count.mean()) if len(ids) else words.count
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item]))
        own = np.bincount(item, impact, len(ids))
        impact = impact / (share * own[item])
        stride = LEAST_STRIDE << np.maximum(0, np.ceil(np.log2(np.maximum(words.count, 1) / LEAST_STRIDE))).astype(np.int64)
        self.terms, self.classes = terms, []
        for length in np.unique(stride[words.count > 0]).tolist():
            members = np.flatnonzero((stride == length) & (words.count > 0))
            slot = np.full(len(ids), -1)
            slot[members] = np.arange(len(members))
            here = slot[item] >= 0
            self.classes.append(_Class(length, members, len(terms), term[here], slot[item[here]], impact[here].astype(np.float32)))

    @property
    def nbytes(self) -> int:
        """Bytes of the posting lists and of the items' shingles."""
        return self.terms.nbytes + sum(c.nbytes for c in self.classes) + sum(p[1].nbytes for s in self.sets for p in s)

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, float, float, float, float]]:
        """(row, item, first word of the passage, score, overlap, question's, answer's), the best passage of each row and item."""
        found: dict[tuple[int, int], tuple] = {}
        for at, to in slices(texts):
            words = words_of(texts.slice(at, to - at), lower=True, plain=True)
            hashes = _hashes(words)
            for row, item, word, score, *overlaps in self._slice(words, hashes):
                key, new = (at + row, item), (overlaps[0], score, -word, *overlaps)
                found[key] = max(found.get(key, new), new)
        return [(row, item, -word, score, *overlaps) for (row, item), (_, score, word, *overlaps) in sorted(found.items())]

    def _slice(self, words: Words, hashes: np.ndarray) -> Iterator[tuple]:
        if not len(self.terms):
            return
        term = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[term] == hashes)
        row = np.repeat(np.arange(len(words.count)), words.count)
        for each in self.classes:
            halves = -(-words.count // each.stride)
            before = np.cumsum(halves) - halves
            at = each.own[term[known]]
            word, at = known[at >= 0], at[at >= 0].astype(np.int64)
            doc = row[word]
            half = (word - words.first[doc]) // each.stride
            place = before[doc] + half
            # A half belongs to the passage it begins, and to the one before it; a last half only to the latter, if there is one.
            own = (half < halves[doc] - 1) | (halves[doc] == 1)
            other = half > 0
            for p, item, score in each.retrieve(np.concatenate([at[own], at[other]]), np.concatenate([place[own], place[other] - 1]), int(halves.sum())):
                r = int(np.searchsorted(before, p, "right")) - 1
                word = int(p - before[r]) * each.stride
                mine = hashes[words.first[r] + word : words.first[r] + min(word + 2 * each.stride, words.count[r])]
                overlaps = [float(np.isin(shingles, shingle_set(mine, size), assume_unique=True).mean()) for size, shingles in self.sets[item]]
                if overlaps[0] >= OVERLAP and min(overlaps) >= PART_OVERLAP:
                    yield r, item, word, score, *overlaps


def indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", answer: str | None = None) -> Iterator[ItemIndex]:
    """One index, or several of at most about ITEM_BYTES of text if there is more."""
    rows = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("q"), (F.col(answer) if answer else F.lit(None).cast("string")).alias("a"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("q"), F.lit(0)) + F.coalesce(F.octet_length("a"), F.lit(0)) + 64)).first()[0] or 0
    parts = -(-size // ITEM_BYTES)
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("id", "q"), F.lit(parts)) == k)
        got = sorted(part.collect(), key=lambda r: (r.id is None, r.id or 0, r.q or ""))
        yield ItemIndex([r.id for r in got], [r.q for r in got], [r.a for r in got] if answer else None)


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", answer: str | None = None) -> DataFrame:
    """doc_id, item_id, word (where the passage begins), score, overlap, question_overlap and answer_overlap of each match."""

    def found_by(index: ItemIndex) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = shared.value.matches(batch.column(1))
                ids = batch.column(0).take(pa.array([m[0] for m in got], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([shared.value.ids[m[1]] for m in got], pa.int64()), pa.array([m[2] for m in got], pa.int64()), *[pa.array([m[k] for m in got], pa.float64()) for k in range(3, 7)]], ["doc_id", "item_id", "word", "score", "overlap", "question_overlap", "answer_overlap"])

        return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda b: given_back(run(b)), "doc_id long, item_id long, word long, score double, overlap double, question_overlap double, answer_overlap double")

    parts = [found_by(index) for index in indexes(items, text="text", answer=answer)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, word long, score double, overlap double, question_overlap double, answer_overlap double")
    return reduce(DataFrame.union, parts)


def flagged(docs: DataFrame, items: DataFrame, text: str = "text", answer: str | None = None) -> DataFrame:
    """docs with contaminated, and item_ids in ascending order."""
    kept = [c for c in docs.columns if c.lower() not in ("contaminated", "item_ids")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.array().cast("array<bigint>").alias("item_ids"))
    for index in indexes(items, answer=answer):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("item_ids").to_pylist()
                for row, item, *_ in shared.value.matches(batch.column(text)):
                    lists[row].append(shared.value.ids[item])
                ids = pa.array([sorted({x for x in one if x is not None}) + [None] * (None in one) for one in lists], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], ids], [*kept, "item_ids"])

        out = out.mapInArrow(lambda b, run=run: given_back(run(b)), out.schema)
    return out.withColumn("contaminated", F.size("item_ids") > 0)


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", answer: str | None = None) -> DataFrame:
    """The documents without any verified test item, with their columns."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_whole"))
    return flagged(rows, items, "_whole", answer).where(~F.col("contaminated")).select("_row.*")
