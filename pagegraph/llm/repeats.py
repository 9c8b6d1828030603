"""Suffix-array dedup: bytes covered by a string of WIDTH bytes that begins at another place too are removed.

Strings are told apart by merging Burrows-Wheeler transforms (see ``bwt``), without sorting all suffixes of the
corpus. What has to be merged is cut down first, exactly. In each WIDTH bytes there is an anchor, the least hash
of GRAM bytes (the first of equals), so equal strings have equal anchors at the same place:

1. Each document gives its anchors, about one in 170 bytes, with the range of string starts that each stands
   for; the bytes of these strings are the anchor's context.
2. Anchors whose gram is nowhere else are dropped. Where one context is at several places, it is repeated as a
   whole, and its copies go on as one. What is left are contexts with a gram, but not the context, in common.
3. These contexts are fetched, dealt out by gram and, in batches, made into shards, whose transforms are merged.
   The repeated intervals say which starts are repeated.
4. The strings found are removed, document by document.

A gram of more than ``CROWD`` contexts is divided until each part fits a merge. The starts before an anchor are dealt
into blocks of 256 neighbours, then 128, and so on; all strings of a block have some bytes around the anchor in
common, more of them the smaller the block is, and contexts are in one part if these bytes are equal. In a part, what
is equal as a whole is repeated as a whole and goes on as one, a context alone is dropped, up to CROWD contexts are
merged, and the rest is divided again. A block of one start has the whole string in common, so it ends there. A
context is at most two rows in each step, however many others share its gram.

The bytes of a symbol are compared before two of them get one name; contexts and parts are told apart by 128 bits of
hash. The lists of a document's contexts and spans are bounded by the document.

Edge cases: a null text is empty; documents shorter than WIDTH stay whole; occurrences may overlap, and may be in
the same document; equal documents of at least WIDTH bytes are removed whole, all of them; rows with the same
doc_id and text are separate documents and get the same result; an empty table gives an empty result. Kept bytes
may end inside a character, so they are bytes, not text. Other columns are not used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.llm._bytes import buffer_of, ragged, slices
from pagegraph.llm._shared import cut, given_back, small, text_of
from pagegraph.llm.bwt import STEP, named, repeated, shard_of, window_hashes

WIDTH = 400
GRAM = 64
#: Contexts of a gram, or of a part of one, that are merged in one task at most.
CROWD = 1000
#: Neighbouring starts of the largest block into which the strings of a crowded gram are dealt.
LARGEST = 256
#: Bytes of contexts that are merged at once, about, and of each shard of them.
BATCH = 1 << 20
SHARD = 1 << 18

_REACH = WIDTH - GRAM  # a string begins at most so many bytes before its anchor
_BITS = 10  # of a distance from an anchor, which is below 1024


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first least value of each window of ``width`` values."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    padded = np.append(values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    index = np.arange(padded.size).reshape(-1, width)
    low = np.minimum.accumulate(padded, axis=1)
    fresh = np.ones(padded.shape, bool)
    fresh[:, 1:] = padded[:, 1:] < low[:, :-1]
    ahead = np.maximum.accumulate(np.where(fresh, index, -1), axis=1).ravel()
    low = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]
    fresh[:, :-1] = padded[:, :-1] <= low[:, 1:]
    fresh[:, -1] = True
    behind = np.minimum.accumulate(np.where(fresh, index, padded.size)[:, ::-1], axis=1)[:, ::-1].ravel()
    a, b = behind[: n - width + 1], ahead[width - 1 : n]
    return np.where(values[a] <= values[b], a, b)


def anchors_of(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """row, place, nearest and farthest start before it, gram and context of each anchor of the texts."""
    buf, offs = buffer_of(texts)
    grams, wides = window_hashes(buf, GRAM, WIDTH)
    size = np.maximum(0, np.diff(offs) - WIDTH + 1)
    row = np.repeat(np.arange(len(size)), size)
    start = ragged(offs[:-1], size)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    place = least_places(grams, _REACH + 1)[start]
    begin = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    end = np.append(begin[1:], len(start)) - 1
    place, row, first, last = place[begin], row[begin], start[begin], start[end]
    near, far = place - last, place - first
    context = (wides[first] ^ (wides[first] >> np.uint64(29))) * np.uint64(0x9E3779B185EBCA87) + wides[last]
    context = (context ^ (near * 1024 + far).astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return row, place - offs[row], near, far, grams[place], context ^ (context >> np.uint64(32))


def _key(doc_id: str, text: str) -> Column:
    return F.xxhash64(F.col(doc_id), text_of(text))


def _packed(place: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    return (place << 2 * _BITS) | (near << _BITS) | far


def _anchors(docs: DataFrame) -> DataFrame:
    """key, spot (place, near and far in one number), gram and context of all anchors of docs (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 19):
                row, place, near, far, gram, context = anchors_of(batch.column(1).slice(a, b - a))
                keys = batch.column(0).slice(a, b - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([keys, pa.array(_packed(place, near, far)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64))], ["key", "spot", "gram", "context"])

    return docs.mapInArrow(lambda b: given_back(run(b)), "key long, spot long, gram long, context long")


def _fetched(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The bytes of each needed context: key, spot, gram, many, crowded and bytes; needed has all but the last."""
    lists = needed.groupBy("key").agg(F.collect_list(F.struct("spot", "gram", "many", "crowded")).alias("list"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << _BITS) - 1
        for batch in batches:
            for i in range(batch.num_rows):
                data = (batch.column(1)[i].as_py() or "").encode()
                rows = batch.column(2)[i].as_py()
                parts = [data[(r["spot"] >> 2 * _BITS) - (r["spot"] & mask) : (r["spot"] >> 2 * _BITS) - (r["spot"] >> _BITS & mask) + WIDTH] for r in rows]
                yield pa.RecordBatch.from_pydict({"key": pa.array([batch.column(0)[i].as_py()] * len(rows), pa.int64()), **{c: [r[c] for r in rows] for c in ("spot", "gram", "many", "crowded")}, "bytes": parts})

    joined = docs.join(lists, "key").select("key", "text", "list")
    return joined.mapInArrow(lambda b: given_back(run(b)), "key long, spot long, gram long, many boolean, crowded boolean, bytes binary")


def _starts_found(parts: list[bytes], near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest distance at which each context has a repeated string; least > greatest: none."""
    length = np.array([len(p) for p in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    start = np.cumsum(length) - length
    names = named(window_hashes(data, STEP)[0], data)
    shards, at = [], 0
    while at < len(parts):
        to = max(at + 1, int(np.searchsorted(start, start[at] + SHARD)))
        shards.append(shard_of(names, start[at:to], length[at:to], WIDTH // STEP))
        at = to
    place = repeated(shards, WIDTH // STEP)
    which = np.searchsorted(start, place, "right") - 1
    distance = far[which] - (place - start[which])
    low, high = np.full(len(parts), WIDTH), np.full(len(parts), -1)
    np.minimum.at(low, which, distance)
    np.maximum.at(high, which, distance)
    return low, high


def _merged(parts: DataFrame) -> DataFrame:
    """key, spot, low and high of each context of one place that has repeated strings; parts: key, spot, part, many, near, far and bytes."""

    def found(rows: list[tuple]) -> pa.RecordBatch:
        low, high = _starts_found([r[6] for r in rows], np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64))
        keep = np.flatnonzero((low <= high) & ~np.array([r[3] for r in rows], bool))
        key, spot = (np.array([r[k] for r in rows], np.int64)[keep] for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(spot), pa.array(low[keep]), pa.array(high[keep])], ["key", "spot", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[2] != part and size > BATCH:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size, part = size + len(row[6]), row[2]
        if held:
            yield found(held)

    rows = parts.select("key", "spot", "part", "many", "near", "far", "bytes")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(lambda b: given_back(run(b)), "key long, spot long, low long, high long")


def _divided(rows: DataFrame, block: int) -> DataFrame:
    """The contexts dealt into blocks of starts: the same columns, and part (the bytes in common) and extent (all bytes) as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, spot, gram, many, near, far, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for first in range(near // block * block, far + 1, block):
                    low, high = max(near, first), min(far, first + block - 1)
                    own = data[far - high : far - low + WIDTH]
                    core = own[high - first : high - first + WIDTH - block + 1]
                    part = hashlib.blake2b(core + b"%d %d" % (gram, first), digest_size=16).digest()
                    out.append((key, spot, gram, many, low, high, own, part, hashlib.blake2b(own + b"%d %d" % (low, high), digest_size=16).digest()))
            columns = list(zip(*out, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = ["key", "spot", "gram", "many", "near", "far", "bytes", "part", "extent"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return rows.select("key", "spot", "gram", "many", "near", "far", "bytes").mapInArrow(lambda b: given_back(run(b)), "key long, spot long, gram long, many boolean, near long, far long, bytes binary, part binary, extent binary")


def _crowded(rows: DataFrame) -> DataFrame:
    """key, spot, low and high for the contexts of crowded grams; rows: key, spot, gram, many, near, far and bytes."""
    found, block = [], LARGEST
    while block and not rows.isEmpty():
        rows = cut(_divided(rows, block))
        extents = cut(rows.groupBy("part", "extent").agg((F.count("*") > 1).alias("again"), F.max("many").alias("seen"), F.min(F.struct("key", "spot")).alias("one")))
        parts = cut(extents.groupBy("part").agg(F.count("*").alias("others"), F.count_if(~F.col("again") & ~F.col("seen")).alias("single")))
        rows = cut(rows.join(extents, ["part", "extent"]).join(parts, "part"))
        found.append(rows.where((F.col("again") | F.col("seen")) & ~F.col("many")).select("key", "spot", F.col("near").alias("low"), F.col("far").alias("high")))
        open_ = (F.col("others") > 1) & (F.col("single") > 0) & (F.struct("key", "spot") == F.col("one"))
        rows = rows.where(open_).select("key", "spot", "gram", (F.col("again") | F.col("seen")).alias("many"), "near", "far", "bytes", "part", "others")
        found.append(_merged(rows.where(F.col("others") <= CROWD)))
        rows, block = rows.where(F.col("others") > CROWD), block // 2
    return reduce(DataFrame.union, found)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """key, first and last byte + 1 of stretches to remove (they may overlap), of docs (key, text)."""
    anchors = cut(_anchors(docs))
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b")).where("n > 1")
    # Written out, so that both sides of the join come straight from an exchange and Spark can split a gram of very many places.
    grams = cut(grams.select("gram", (F.col("a") == F.col("b")).alias("alike")))
    near = cut(anchors.join(grams, "gram"))
    contexts = near.where(~F.col("alike")).groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "spot")).alias("one"))
    contexts = cut(contexts.select("gram", "context", "n", "one.key", "one.spot"))
    by_gram = cut(contexts.groupBy("gram").agg(F.count("*").alias("others"), F.count_if(F.col("n") == 1).alias("single")).where("single > 0"))
    needed = contexts.join(by_gram, "gram").select("key", "spot", "gram", (F.col("n") > 1).alias("many"), (F.col("others") > CROWD).alias("crowded"))
    fetched = cut(_fetched(docs, needed))
    place, near_by, far = F.shiftright("spot", 2 * _BITS), F.shiftright("spot", _BITS).bitwiseAND((1 << _BITS) - 1), F.col("spot").bitwiseAND((1 << _BITS) - 1)
    ranged = fetched.withColumns({"near": near_by, "far": far})
    parts = _merged(ranged.where(~F.col("crowded")).withColumn("part", F.unhex(F.hex("gram"))))
    crowd = ranged.where("crowded")
    if not crowd.isEmpty():
        parts = parts.union(_crowded(crowd))
    whole = near.where("alike").select("key", "spot").union(near.where(~F.col("alike")).join(small(contexts.where("n > 1").select("gram", "context")), ["gram", "context"], "left_semi").select("key", "spot"))
    return whole.select("key", (place - far).alias("first"), (place - near_by + WIDTH).alias("last")).union(parts.select("key", (place - F.col("high")).alias("first"), (place - F.col("low") + WIDTH).alias("last")))


def _spans_of(rows: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs, in order."""
    out: list[list[int]] = []
    for first, last in sorted((r["first"], r["last"]) for r in rows or []):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def repeat_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and repeated (whether any byte is removed) of every row; with_bytes: spans and the kept bytes too."""
    keyed = docs.select(_key(doc_id, text).alias("key"), F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # Rows with the same doc_id and text share a key, and so one of their anchors counts as often as there are rows.
    spans = repeated_spans(keyed.select("key", "text")).groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for doc, item, rows in zip(ids, batch.column(1), batch.column(2), strict=True):
                data, found = (item.as_py() or "").encode(), _spans_of(rows.as_py())
                edges = [0, *(x for span in found for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), bool(found), [{"first": a, "last": b} for a, b in found], kept)[: 8 if with_bytes else 6])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated"] + ["spans", "kept"] * with_bytes
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()] + [pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.binary()] * with_bytes
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean" + ", spans array<struct<first: long, last: long>>, kept binary" * with_bytes
    return keyed.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(lambda b: given_back(run(b)), schema)
