"""Near-duplicate groups by wide SimHash: word shingles of five words, similarity of 0.8 or more.

At that similarity two texts' fingerprints differ in up to one bit of six, too many for the two halves that
``simhash`` uses. Here a fingerprint has WORDS + 1 words of 64 bits. Of each of the first WORDS, three segments of
SEGMENT_BITS bits are indexed under their one-wildcard variants; texts that share a variant (one segment that
differs by at most one bit) are compared by the last word, then by the whole fingerprint, and verified by the Jaccard
index of the shingle sets themselves. The verified links make groups. Equal texts are one text before all this.

A pair of similarity 0.8 shares a variant with probability 0.975, one of 0.85 with 0.995 (computed). Two unrelated texts share
one by chance once in about 500; where there are far more than ten million texts, SEGMENT_BITS should grow with the
logarithm of their number, and WORDS with it.

Large families of near copies have pairs without end, so pairs are never rows:

1. Of each word, texts with the same first segment are compared with the least one. What is verified makes groups.
2. The texts of a variant are compared, in numpy, with those of other groups, and a row holds many pairs. A variant
   of more than HELD texts goes on in chunks, and chunks are compared with each other.
3. Texts are dealt into blocks of BLOCK_BYTES of shingles, pairs into tiles of two blocks. A task holds the shingles
   of one tile, verifies its pairs, and gives one link for any two groups that it joins.

No pair that shares a variant and passes the tests of the fingerprint is left out, unless its texts are in one group
already.

Edge cases: texts without words are alike; a text of fewer words than a shingle has one of all its words. In a
group the least doc_id stays, null last, and one row of it, also where rows are repeated or ids are null. An empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.llm._bytes import ragged, shingles_of, slices, words_of, xxh64
from pagegraph.llm._shared import cut, given_back, small, text_of
from pagegraph.llm.components import components
from pagegraph.llm.simhash import SEED, fingerprints_of

SHINGLE = 5
SIMILAR = 0.8
WORDS = 5
PER_WORD = 3
SEGMENT_BITS = 18
#: Differing bits up to which a candidate goes on: of the last word without its top bit, and of the whole fingerprint.
SKETCH_MOST = 18
WHOLE_MOST = 78
#: Texts of a variant that are compared all at once; those of a larger one go in squares of SIDE; more than HELD in chunks.
WIDE, SIDE, HELD = 64, 512, 1 << 17
#: Bytes of shingles of a block.
BLOCK_BYTES = 16 << 20
#: Pairs that are held before they are verified.
PAIRS = 1 << 20
#: Texts whose shingles are fetched by broadcast of their ids; more of them by a shuffled join.
FETCHED_ROWS = 100_000
#: Texts whose hashes are broadcast in the end; 8 bytes each.
ODD_ROWS = 1_000_000

_PRINTS = [f"f{k}" for k in range(WORDS + 1)]
_LOW = (1 << 63) - 1


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """Independent hashes from one."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        x = (h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _distinct(hashes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, and how many; ``hashes`` has ``count`` of each text."""
    ends = np.cumsum(count)
    sets = [np.unique(hashes[e - c : e]) for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
    return np.concatenate([hashes[:0], *sets]), np.array([len(s) for s in sets], np.int64)


def wide_prints(rows: DataFrame) -> DataFrame:
    """rows (key, doc_id, text) as key, doc_id, n (distinct shingles) and the words of their fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, parts = batch.column(2), [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in _PRINTS]
            for at, to in slices(texts):
                words = words_of(texts.slice(at, to - at), lower=True)
                start, end, count = shingles_of(words, SHINGLE)
                h, count = _distinct(xxh64(words.data, start, end, SEED), count)
                sizes.append(count)
                for k, part in enumerate(parts):
                    part.append(fingerprints_of(_spread(h, k), count))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(sizes)), *[pa.array(np.concatenate(p).view(np.int64)) for p in parts]], ["key", "doc_id", "n", *_PRINTS])

    return rows.mapInArrow(lambda b: given_back(run(b)), "key long, doc_id long, n long, " + ", ".join(f"{f} long" for f in _PRINTS))


def _gap(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}{f}").bitwiseXOR(F.col(f"{b}{f}"))) for f in _PRINTS), F.lit(0))


def star_pairs(prints: DataFrame) -> DataFrame:
    """a and b: texts whose first segment in some word is equal, each with the least of them, if close by fingerprint."""
    first = [F.col(f).bitwiseAND((1 << SEGMENT_BITS) - 1).bitwiseOR(F.lit(k << SEGMENT_BITS)) for k, f in enumerate(_PRINTS[:WORDS])]
    rows = prints.select("node", *_PRINTS, F.explode(F.array(*first)).alias("segment"))
    least = rows.groupBy("segment").agg(F.count("*").alias("n"), F.min(F.struct("node", *_PRINTS)).alias("least")).where("n > 1")
    # Written out, so that both sides of the join come straight from an exchange and Spark can split a hot segment.
    least = cut(least.select("segment", F.col("least.node").alias("a"), *[F.col(f"least.{f}").alias(f"a{f}") for f in _PRINTS]))
    return rows.join(least, "segment").where((F.col("node") != F.col("a")) & (_gap("a", "") <= WHOLE_MOST)).select("a", F.col("node").alias("b")).distinct()


def _variants(prints: DataFrame) -> DataFrame:
    """key (variant and segment with the bit blanked), mark (that bit, and the last word's other 63), node, and group.

    The group is given as its difference from the node, which is 0 in most rows and so packs well.
    """
    per = PER_WORD * SEGMENT_BITS
    n, v = WORDS * per, F.col("v")
    shift = F.call_function("shiftleft", F.lit(1), F.pmod(v, F.lit(SEGMENT_BITS)))
    word = F.element_at(F.array(*_PRINTS[:WORDS]), F.floor(v / per).cast("int") + 1)
    segment = F.call_function("shiftrightunsigned", word, F.floor(F.pmod(v, F.lit(per)) / SEGMENT_BITS).cast("int") * SEGMENT_BITS).bitwiseAND((1 << SEGMENT_BITS) - 1).cast("int")
    key = F.call_function("shiftleft", v, F.lit(SEGMENT_BITS)).bitwiseOR(segment.bitwiseAND(F.bitwise_not(shift)))
    bit = F.when(segment.bitwiseAND(shift) != 0, F.lit(-(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    rows = prints.select("node", "group", *_PRINTS, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("v"))
    return rows.select(key.alias("key"), F.col(_PRINTS[WORDS]).bitwiseAND(F.lit(_LOW)).bitwiseOR(bit).alias("mark"), "node", F.col("node").bitwiseXOR(F.col("group")).alias("group"))


def _alike(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether marks a and b under the variant ``key`` are close, and this is the first variant of an equal segment."""
    differ = a ^ b
    near = np.bitwise_count(differ & np.uint64(_LOW)) <= SKETCH_MOST
    # Segments that are equal share all their variants; the first one speaks for them.
    return near & ((differ >> np.uint64(63) != 0) | ((key >> SEGMENT_BITS) % SEGMENT_BITS == 0))


def _pairs_of(key: np.ndarray, mark: np.ndarray, group: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of close pairs of different groups that have the same key; rows are sorted by key."""
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    few = (size > 1) & (size <= wide)
    left = ragged(begin[few], size[few])
    at = np.repeat(begin[few] + size[few], size[few])
    step = 1
    while len(left):
        live = left + step < at
        left, at = left[live], at[live]
        found = (group[left] != group[left + step]) & _alike(key[left], mark[left], mark[left + step])
        yield left[found], left[found] + step
        step += 1
    for b, s in zip(begin[size > wide].tolist(), size[size > wide].tolist(), strict=True):
        own = b + np.argsort(group[b : b + s], kind="stable")
        yield from _square(key[b], mark, group, own, own)


def _square(key: int, mark: np.ndarray, group: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for two lists of indexes that are sorted by group, or one with itself."""
    same = rows is columns
    for i in range(0, len(rows), SIDE):
        for j in range(i if same else 0, len(columns), SIDE):
            one, two = rows[i : i + SIDE], columns[j : j + SIDE]
            low, high = min(group[one[0]], group[two[0]]), max(group[one[-1]], group[two[-1]])
            if low == high:
                continue
            close = (group[one][:, None] != group[two][None, :]) & _alike(np.int64(key), mark[one][:, None], mark[two][None, :])
            x, y = np.nonzero(np.triu(close) if same and i == j else close)
            if len(x):
                yield one[x], two[y]


class _Found:
    """Pairs of nodes by tile, and the nodes of each tile, as record batches: kind 0 has pairs x and y, kind 1 nodes x."""

    names = ["kind", "tile", "x", "y"]
    schema = "kind int, tile long, x array<long>, y array<long>"

    def __init__(self, blocks: int):
        self.blocks, self.held, self.nodes = blocks, 0, {}

    def rows(self, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(x):
            return
        p, q = (_spread(v.view(np.uint64), 5) % np.uint64(self.blocks) for v in (x, y))
        tile = (np.minimum(p, q) * np.uint64(self.blocks) + np.maximum(p, q)).view(np.int64)
        order = np.argsort(tile, kind="stable")
        x, y, tile = x[order], y[order], tile[order]
        begin = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
        yield self._batch(0, tile[begin], begin, x, y)
        for t, b, e in zip(tile[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(tile)], strict=True):
            new = np.unique(np.concatenate([x[b:e], y[b:e], self.nodes.get(t, x[:0])]))
            self.held += len(new) - len(self.nodes.get(t, ()))
            self.nodes[t] = new
        if self.held > PAIRS:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.nodes:
            sizes = np.array([len(v) for v in self.nodes.values()])
            yield self._batch(1, np.array(list(self.nodes)), np.cumsum(sizes) - sizes, np.concatenate(list(self.nodes.values())), None)
        self.held, self.nodes = 0, {}

    def _batch(self, kind: int, tile: np.ndarray, begin: np.ndarray, x: np.ndarray, y: np.ndarray | None) -> pa.RecordBatch:
        offsets, none = pa.array(np.append(begin, len(x)).astype(np.int32)), pa.array(np.zeros(len(tile) + 1, np.int32))
        other = pa.ListArray.from_arrays(none, pa.array([], pa.int64())) if y is None else pa.ListArray.from_arrays(offsets, pa.array(y))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(tile), kind, np.int32)), pa.array(tile), pa.ListArray.from_arrays(offsets, pa.array(x)), other], self.names)


_CHUNK = "key int, chunk int, mark array<long>, node array<long>, group array<long>"


def _by_variant(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[int | None, list[np.ndarray]]]:
    """(None, columns of whole variants), or (number, columns of one chunk) of a variant of more than ``held`` rows."""
    rest, chunk = None, 0
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        while len(columns[0]) and (chunk or columns[0][0] == columns[0][-1]):
            n = int(np.searchsorted(columns[0], columns[0][0], "right"))
            if n < len(columns[0]) and chunk:
                yield chunk, [c[:n] for c in columns]
                columns, chunk = [c[n:] for c in columns], 0
            elif n > held:
                yield chunk, [c[:held] for c in columns]
                columns, chunk = [c[held:] for c in columns], chunk + 1
            else:
                break
        whole = int(np.searchsorted(columns[0], columns[0][-1])) if len(columns[0]) and not chunk else 0
        if whole:
            yield None, [c[:whole] for c in columns]
        rest = [c[whole:] for c in columns]
    if rest is not None and len(rest[0]):
        yield chunk or None, rest


def candidates(grouped: DataFrame, blocks: int, wide: int = WIDE, held: int = HELD) -> DataFrame:
    """Rows of ``_Found``: all pairs of nodes of different groups that share a variant and are close by the last word."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(blocks)
        empty = pa.array([None], pa.list_(pa.int64()))
        for chunk, (key, mark, node, group) in _by_variant(batches, held):
            group = node ^ group
            if chunk is None:
                pairs = list(_pairs_of(key.astype(np.int64), mark.view(np.uint64), group, wide))
                x, y = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
                for out in found.rows(node[x], node[y]):
                    yield pa.RecordBatch.from_arrays([*out.columns, *[pa.nulls(out.num_rows, t) for t in (pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3)]], names)
            else:
                lists = [pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), pa.array(c)) for c in (mark, node, group)]
                yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0]), empty, empty, pa.array([key[0]], pa.int32()), pa.array([chunk], pa.int32()), *lists], names)
        for out in found.close():
            yield pa.RecordBatch.from_arrays([*out.columns, *[pa.nulls(out.num_rows, t) for t in (pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3)]], names)

    names = [*_Found.names, "key", "chunk", "mark", "node", "group"]
    every = cut(_variants(grouped).repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: given_back(chunks(b)), f"{_Found.schema}, {_CHUNK}"))
    found = every.where("kind < 2").select(*_Found.names)
    large = every.where("kind = 2").select("key", "chunk", "mark", "node", "group")
    if large.isEmpty():
        return found

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(blocks)
        for batch in batches:
            for i in range(batch.num_rows):
                key, same, *lists = [c[i] for c in batch.columns]
                mark, node, group, more_mark, more_node, more_group = (v.values.to_numpy() for v in lists)
                n = len(mark)
                mark, node, group = (np.concatenate(v) for v in ((mark, more_mark), (node, more_node), (group, more_group)))
                one, two = np.argsort(group[:n], kind="stable"), n + np.argsort(group[n:], kind="stable")
                for x, y in _square(key.as_py(), mark.view(np.uint64), group, one, one if same.as_py() else two):
                    yield from found.rows(node[x], node[y])
        yield from found.close()

    other = large.select("key", F.col("chunk").alias("other"), *[F.col(c).alias(f"more_{c}") for c in ("mark", "node", "group")])
    both = large.join(other, "key").where("chunk <= other").select("key", (F.col("chunk") == F.col("other")).alias("same"), "mark", "node", "group", "more_mark", "more_node", "more_group")
    return found.union(both.mapInArrow(lambda b: given_back(crossed(b)), _Found.schema))


def _shingle_sets(rows: DataFrame) -> DataFrame:
    """rows (node, text) as node and the sorted distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for at, to in slices(batch.column(1)):
                words = words_of(batch.column(1).slice(at, to - at), lower=True)
                start, end, count = shingles_of(words, SHINGLE)
                h = (xxh64(words.data, start, end, SEED) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                ends = np.cumsum(count)
                sets += [np.unique(h[e - c : e]) for e, c in zip(ends.tolist(), count.tolist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *sets])))], ["node", "set"])

    return rows.mapInArrow(lambda b: given_back(run(b)), "node long, set array<int>")


def _sets_of(nodes: DataFrame, each: DataFrame, rows: DataFrame) -> DataFrame:
    """node and set of each of the nodes."""
    wanted = cut(nodes.distinct().join(each.select("node", "key", "keep"), "node"))
    texts = rows.join(small(wanted, FETCHED_ROWS), "key").where(rows["doc_id"].eqNullSafe(F.col("keep")))
    return cut(_shingle_sets(texts.select("node", "text").dropDuplicates(["node"])))


def _verified(pairs: DataFrame, each: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are similar."""
    pairs = cut(pairs)
    sets = _sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), each, rows)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("two")), "b")
    shared = F.size(F.array_intersect("one", "two"))
    union = F.size("one") + F.size("two") - shared
    return cut(both.where((union == 0) | (shared >= F.lit(SIMILAR) * union)).select("a", "b"))


class _Tile:
    """The texts of one tile; takes pairs of them and gives those that join two groups."""

    def __init__(self, node: np.ndarray, group: np.ndarray, prints: np.ndarray, sets: list[np.ndarray]):
        order = np.argsort(node)
        self.node, self.prints, self.sets = node[order], prints[order], [sets[i] for i in order.tolist()]
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.root = np.unique(group[order], return_inverse=True)[1].tolist()
        self.parent = list(range(len(set(self.root))))

    def _find(self, i: int) -> int:
        g = self.root[i]
        while self.parent[g] != g:
            self.parent[g] = self.parent[self.parent[g]]
            g = self.parent[g]
        return g

    def links(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        x, y = np.searchsorted(self.node, x), np.searchsorted(self.node, y)
        both = np.unique(np.minimum(x, y) * len(self.node) + np.maximum(x, y))
        x, y = both // len(self.node), both % len(self.node)
        size_x, size_y = self.size[x], self.size[y]
        may = np.minimum(size_x, size_y) >= SIMILAR * np.maximum(size_x, size_y)
        x, y = x[may], y[may]
        near = np.bitwise_count(self.prints[x] ^ self.prints[y]).sum(axis=1, dtype=np.int64) <= WHOLE_MOST
        x, y = x[near], y[near]
        out = []
        for b, e in zip(*(lambda at: (at, [*at[1:], len(x)]))(np.flatnonzero(np.append(True, x[1:] != x[:-1])).tolist() if len(x) else []), strict=True):
            i, others = int(x[b]), [j for j in y[b:e].tolist() if self._find(j) != self._find(int(x[b]))]
            if not others:
                continue
            own, many = self.sets[i], self.size[others]
            if len(own):
                flat = np.concatenate([self.sets[j] for j in others])
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                ends = np.cumsum(many)
                upto = np.concatenate([[0], np.cumsum(hit)])
                shared = upto[ends] - upto[ends - many]
            else:
                shared = np.zeros(len(others), np.int64)
            union = len(own) + many - shared
            for j in np.array(others)[(union == 0) | (shared >= SIMILAR * union)].tolist():
                p, q = self._find(i), self._find(j)
                if p != q:
                    self.parent[p] = q
                    out.append((int(self.node[i]), int(self.node[j])))
        return out


def _tile_links(rows: DataFrame) -> DataFrame:
    """a and b from rows of tile, kind, node, group, prints, set (kind 0) and x, y (kind 1), sorted by tile and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, tile, pairs, held = None, [], None, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if pairs:
                got = tile.links(*(np.concatenate(p) for p in zip(*pairs, strict=True)))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["a", "b"])

        for batch in batches:
            tiles, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            node, group, prints, sets, x, y = batch.columns[2:]
            for i in range(batch.num_rows):
                if tiles[i] != now:
                    yield from out()
                    now, texts, tile, pairs, held = tiles[i], [], None, [], 0
                if kinds[i] == 0:
                    texts.append((node[i].as_py(), group[i].as_py(), prints[i].values.to_numpy().view(np.uint64), sets[i].values.to_numpy().copy()))
                    continue
                if tile is None:
                    nodes, groups, words, each = zip(*texts, strict=True)
                    tile, texts = _Tile(np.array(nodes, np.int64), np.array(groups, np.int64), np.stack(words), list(each)), []
                pairs.append((x[i].values.to_numpy().copy(), y[i].values.to_numpy().copy()))
                held += len(pairs[-1][0])
                if held >= PAIRS:
                    yield from out()
                    pairs, held = [], 0
        yield from out()

    return rows.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(lambda b: given_back(run(b)), "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", wide: int = WIDE, held: int = HELD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key (hash of the text), n_rows, keep_id and keep_key (the doc_id that stays, and its text's hash) of every distinct text."""
    rows = docs.select(F.xxhash64(text_of(text)).alias("key"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    each = wide_prints(rows).groupBy("key").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n_rows"), *[F.min(f).alias(f) for f in ("n", *_PRINTS)])
    each = cut(each.withColumn("node", F.coalesce("keep", "key")))
    prints = each.select("node", *_PRINTS)
    links = _verified(star_pairs(prints), each, rows)
    linked = components(links)
    grouped = prints.join(linked, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    grouped = cut(grouped)
    shingles = each.agg(F.sum("n")).first()[0] or 0
    found = cut(candidates(grouped, max(1, -(-4 * shingles // block_bytes)), wide, held))
    tiles = found.where("kind = 1").groupBy("tile").agg(F.array_distinct(F.flatten(F.collect_list("x"))).alias("nodes"))
    tiles = cut(tiles.select("tile", F.explode("nodes").alias("node")))
    sets = _sets_of(tiles.select("node"), each, rows)
    texts = tiles.join(sets, "node").join(grouped.select("node", "group", F.array(*_PRINTS).alias("prints")), "node")
    none = F.lit(None)
    texts = texts.select("tile", F.lit(0).alias("kind"), "node", "group", "prints", "set", none.cast("array<long>").alias("x"), none.cast("array<long>").alias("y"))
    pairs = found.where("kind = 0").select("tile", F.lit(1).alias("kind"), *[none.cast(t).alias(c) for c, t in (("node", "long"), ("group", "long"), ("prints", "array<long>"), ("set", "array<int>"))], "x", "y")
    linked = components(links.union(cut(_tile_links(texts.union(pairs)))))
    first = F.struct(F.col("keep").isNull().alias("last"), F.col("keep").alias("keep_id"), F.col("key").alias("keep_key"))
    least = linked.join(each.select("node", "keep", "key"), "node").groupBy("component").agg(F.min(first).alias("first"))
    of_node = linked.join(least, "component").select("node", "first")
    return cut(each.join(of_node, "node", "left").withColumn("first", F.coalesce("first", first)).select("key", "n_rows", "first.keep_id", "first.keep_key"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", wide: int = WIDE, held: int = HELD, block_bytes: int = BLOCK_BYTES, odd_rows: int = ODD_ROWS) -> DataFrame:
    """docs with one row of each group.

    Most texts are alone in their group and in one row. Where the others are up to ``odd_rows`` texts, their hashes are
    broadcast: rows of none of them stay where they are, and only the rows that stay of texts in several rows are
    shuffled. Beyond that, all rows are dealt out by the hash of their text, once.
    """
    spec = near_groups(docs, doc_id, text, wide, held, block_bytes)
    keyed = docs.withColumn("_key", F.xxhash64(text_of(text)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    stays = spec.where("key = keep_key").select(F.col("key").alias("_key"), F.col("keep_id").alias("_keep"), F.col("n_rows").alias("_n"))
    own = F.col(f"`{doc_id}`").eqNullSafe(F.col("_keep"))
    odd = spec.where("key <> keep_key or n_rows > 1").select(F.col("key").alias("_key"))
    if odd.limit(odd_rows + 1).count() > odd_rows:
        return keyed.join(stays, "_key").where(own).dropDuplicates(["_key"]).select(*columns)
    alone = keyed.join(F.broadcast(odd), "_key", "left_anti").select(*columns)
    return alone.union(keyed.join(F.broadcast(stays.where("_n > 1")), "_key").where(own).dropDuplicates(["_key"]).select(*columns))
