"""SimHash near-duplicates: one-wildcard variants of two segments, joined by equality and verified.

Fingerprints of 64 bits that differ in at most two are the same, up to one bit, in one of their two halves. Each
half is indexed under 32 variants, with one bit blanked out in turn, so two halves that differ by at most one
bit share a variant. Fingerprints that share one are compared in full, and only the first shared variant of a
pair gives a link.

Equal texts are one fingerprint before anything is joined. A variant that more than ``WIDE`` different
fingerprints share is not compared pair by pair: its fingerprints are given their 64 neighbours at one bit, and
two fingerprints differ in at most two bits exactly if they share one of these or are one. Each then links to the
least fingerprint with the same neighbour, which gives the same components from no more links than rows.

Edge cases: a null or blank text has fingerprint zero and is linked like any other. The least doc_id stands for
a component, null last; repeated rows each get a row; an empty table gives an empty result; columns other than
doc_id and text are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm._bytes import ragged, shingles_of, slices, words_of, xxh64
from pagegraph.llm._shared import cut, given_back
from pagegraph.llm.components import components

SEED = 42
MOST_BITS = 2
#: Different fingerprints that share a variant up to which each pair of them is compared.
WIDE = 64

_ONES = np.uint64(0x0101010101010101)


def fingerprints_of(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from the hashes of its shingles, ``count`` of them each."""
    chunks = -(-count // 255)
    starts = ragged(np.zeros(len(count), np.int64), chunks) * 255 + np.repeat(np.cumsum(count) - count, chunks)
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    first = (np.cumsum(chunks) - chunks)[some]
    need = count[some][:, None]
    for k in range(8):
        # Bit k of each of the 8 bytes, added up in bytes of at most 255 hashes, then over all of a text.
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _ONES, starts).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
        over = (2 * total > need).astype(np.uint64)
        out[some] |= (over << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, parts = batch.column(1), [np.zeros(0, np.uint64)]
            for at, to in slices(texts):
                words = words_of(texts.slice(at, to - at), lower=True)
                start, end, count = shingles_of(words, shingle)
                parts.append(fingerprints_of(xxh64(words.data, start, end, SEED), count))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lambda b: given_back(run(b)), "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """key and fp: half and blanked bit in the upper bits, then the half with that bit blank."""
    v = F.col("v")
    half = F.when(v < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    blank = F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(v, F.lit(32))))
    key = F.call_function("shiftleft", v.cast("bigint"), F.lit(32)).bitwiseOR(half.bitwiseAND(blank))
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select(key.alias("key"), "fp")


def _first_variant(differ: np.ndarray) -> np.ndarray:
    """The first variant that two fingerprints of this difference share."""
    low, high = differ & np.uint64(0xFFFFFFFF), differ >> np.uint64(32)
    near = np.bitwise_count(low) <= 1
    half = np.where(near, low, high)
    bit = np.where(half == 0, 0, np.bitwise_count(half - np.uint64(1)))
    return np.where(near, 0, 32) + np.where(half == 0, 0, bit)


class _Groups:
    """Takes rows sorted by key, batch by batch; gives links within a key, and fingerprints of wide keys."""

    def __init__(self, wide: int):
        self.wide = wide
        self.key, self.fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.over: int | None = None

    def feed(self, key: np.ndarray, fp: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, fp = np.concatenate([self.key, key]), np.concatenate([self.fp, fp])
        wide = []
        if self.over is not None:
            n = int(np.searchsorted(key, self.over, "right"))
            wide.append(fp[:n])
            key, fp = key[n:], fp[n:]
            if len(key):
                self.over = None
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(key)))
        if len(begin) and not last:
            if size[-1] > self.wide:
                self.over = int(key[-1])
                self.key, self.fp = key[:0], fp[:0]
            else:
                self.key, self.fp = key[begin[-1] :], fp[begin[-1] :]
                begin, size = begin[:-1], size[:-1]
        else:
            self.key, self.fp = key[:0], fp[:0]
        many = size > self.wide
        wide.append(fp[ragged(begin[many], size[many])])
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        begin, size = begin[(size > 1) & ~many], size[(size > 1) & ~many]
        at = ragged(begin, size)
        rest = ragged(np.zeros(len(size), np.int64), size)
        rest = np.repeat(size, size) - rest - 1  # how many of the group follow
        step = 1
        while len(at):
            live = rest >= step
            at, rest = at[live], rest[live]
            x, y = fp[at], fp[at + step]
            differ = x ^ y
            found = (np.bitwise_count(differ) <= MOST_BITS) & (_first_variant(differ) == key[at] >> 32)
            left.append(x[found])
            right.append(y[found])
            step += 1
        return np.concatenate(left), np.concatenate(right), np.unique(np.concatenate(wide))


def near_links(fps: DataFrame, wide: int = WIDE) -> DataFrame:
    """a and b: distinct fingerprints (column fp) that differ in one or two bits; enough of them for all components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _Groups(wide)

        def out(a: np.ndarray, b: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, many]).view(np.int64)), pa.array(np.concatenate([b, many]).view(np.int64))], ["a", "b"])

        for batch in batches:
            yield out(*groups.feed(batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
        yield out(*groups.feed(np.zeros(0, np.int64), np.zeros(0, np.uint64), last=True))

    # The fingerprints are few bytes, and 64 rows come from each: they are dealt out by number first.
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    sorted_keys = _variants(fps).repartition("key").sortWithinPartitions("key")
    found = cut(sorted_keys.mapInArrow(lambda b: given_back(run(b)), "a long, b long"))
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(x if x < 1 << 63 else x - (1 << 64)).cast("bigint") for x in (1 << k for k in range(64))])
    beside = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("beside"))
    least = beside.groupBy("beside").agg(F.min("fp").alias("least"))
    more = beside.join(least, "beside").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return found.where("a <> b").union(more)


def simhash_components(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text", wide: int = WIDE) -> DataFrame:
    """doc_id, fingerprint in hex, and component_id of every row."""
    prints = cut(fingerprints(docs, shingle, doc_id, text))
    each = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    linked = components(near_links(each.select("fp"), wide)).withColumnRenamed("node", "fp")
    least = linked.join(each, "fp").groupBy("component").agg(F.min("node").alias("component_id"))
    of_print = linked.join(least, "component").select("fp", "component_id")
    # Written out, so that both sides of the last join come straight from an exchange, which Spark can split where a fingerprint is hot.
    known = cut(each.join(of_print, "fp", "left").select("fp", F.coalesce("component_id", "node").alias("component_id")))
    return prints.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
