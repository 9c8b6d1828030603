"""Token ids in binary files: blocks of ids, transposed into bit or byte planes, each compressed by itself.

A file holds whole documents in order. Blocks of BLOCK ids, each id little-endian unsigned 32-bit, are cut into
planes (4 of bytes or 32 of bits); the planes of low significance take what zstandard leaves of them and the
high ones almost nothing. Layout:

    magic | planes of block 0 | planes of block 1 | ... | footer | u64 length of the footer | magic

The footer is zstandard-compressed: a JSON line with the mode and counts, then as arrays of little-endian 64-bit
integers the chunk index (offset of each block, size of each of its planes; an all-zero plane has size 0) and
the documents (doc_id, whether it is null, number of ids).

``write_tokens`` deals the documents out by ranges of doc_id, so that files and the ids in them are in ascending
order, and gives one row for each file. A task that runs again writes the same file. ``read_tokens`` gives each
document's place and a checksum; ``decode_file`` gives the ids of a file.

Edge cases: a null text has only the end id; a null doc_id comes last; documents with equal doc_ids are ordered
by text and each have their own row; an empty table gives no files and no rows; other columns are not used.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.llm._files import opened, written
from pagegraph.llm._shared import cut, given_back, shared_path
from pagegraph.llm._tokenize import FastEncoder

MAGIC = b"PGTOKEN1"
BLOCK = 1 << 17
LEVEL = 1


def planes_of(ids: np.ndarray, mode: str) -> np.ndarray:
    """One row for each plane, least significant first."""
    byte = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return np.ascontiguousarray(byte.T)
    if mode == "bit":
        return np.packbits(np.unpackbits(byte, axis=1, bitorder="little").T, axis=1, bitorder="little")
    raise ValueError(f"mode is byte or bit, not {mode}")


def ids_of(planes: np.ndarray, n: int, mode: str) -> np.ndarray:
    """The inverse of planes_of."""
    if mode == "byte":
        byte = np.ascontiguousarray(planes.T)
    else:
        byte = np.packbits(np.unpackbits(planes, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
    return np.ascontiguousarray(byte).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes documents' ids to a stream; holds one block of them."""

    def __init__(self, out, mode: str = "byte", block: int = BLOCK, level: int = LEVEL):
        self.out, self.mode, self.block = out, mode, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held: list[np.ndarray] = []
        self.n_held, self.at, self.n_ids = 0, len(MAGIC), 0
        self.index: list[list[int]] = []
        self.docs: list[np.ndarray] = []
        out.write(MAGIC)

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents, and the ids of all of them on end."""
        self.docs.append(np.stack([doc_ids, nulls.astype(np.int64), counts]).astype("<i8"))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            whole = np.concatenate(self.held)
            upto = len(whole) // self.block * self.block
            for k in range(0, upto, self.block):
                self._put(whole[k : k + self.block])
            self.held, self.n_held = [whole[upto:]], len(whole) - upto

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.pack(p.tobytes()) if p.any() else b"" for p in planes_of(ids, self.mode)]
        self.index.append([self.at, *map(len, packed)])
        for part in packed:
            self.out.write(part)
        self.at += sum(map(len, packed))
        self.n_ids += len(ids)

    def close(self) -> None:
        last = np.concatenate([np.zeros(0, np.uint32), *self.held])
        if len(last):
            self._put(last)
        docs = np.concatenate([np.zeros((3, 0), "<i8"), *self.docs], axis=1)
        head = {"mode": self.mode, "block": self.block, "ids": self.n_ids, "blocks": len(self.index), "planes": 4 if self.mode == "byte" else 32, "docs": docs.shape[1]}
        footer = self.pack(json.dumps(head).encode() + b"\n" + np.array(self.index, "<i8").tobytes() + docs.tobytes())
        self.out.write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class PlaneReader:
    """Reads a file by its chunk index; ``docs`` has doc_id, null flag and count of each document."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of token planes, or cut off")
        length = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - length)
        self.unpack = zstandard.ZstdDecompressor()
        head, _, rest = self.unpack.decompress(source.read(length)).partition(b"\n")
        self.head = json.loads(head)
        numbers = np.frombuffer(rest, "<i8")
        width = self.head["planes"] + 1
        self.index = numbers[: self.head["blocks"] * width].reshape(-1, width)
        self.docs = numbers[self.head["blocks"] * width :].reshape(3, -1)

    def block(self, k: int) -> np.ndarray:
        """The ids of block k."""
        n = min(self.head["block"], self.head["ids"] - k * self.head["block"])
        row = n if self.head["mode"] == "byte" else -(-n // 8)
        self.source.seek(int(self.index[k, 0]))
        planes = np.zeros((self.head["planes"], row), np.uint8)
        for p, size in enumerate(self.index[k, 1:].tolist()):
            if size:
                planes[p] = np.frombuffer(self.unpack.decompress(self.source.read(size)), np.uint8)
        return ids_of(planes, n, self.head["mode"])

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of each document in turn; holds the blocks of one document."""
        held, k = np.zeros(0, np.uint32), 0
        at = 0
        for doc_id, null, count in self.docs.T.tolist():
            if at + count > len(held):
                parts, n = [held[at:]], len(held) - at
                while n < count:
                    parts.append(self.block(k))
                    n += len(parts[-1])
                    k += 1
                held, at = np.concatenate(parts), 0
            yield (None if null else doc_id), held[at : at + count]
            at += count


def decode_file(uri: str) -> list[tuple[int | None, list[int]]]:
    """All documents of one file."""
    with opened(uri) as source:
        return [(d, ids.tolist()) for d, ids in PlaneReader(source).documents()]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, doc_id: str = "doc_id", text: str = "text", mode: str = "byte", block: int = BLOCK) -> DataFrame:
    """Writes the files and gives part, path, n_docs and n_ids of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}.planes"
        encoder, n_docs, n_ids, writer = None, 0, 0, None
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with written(path) as out:
            writer, encoder = PlaneWriter(out, mode, block), FastEncoder(tokenizer)
            batch = first
            while batch is not None:
                for a, b, ids, counts in encoder.encode(batch.column(1)):
                    own = batch.column(0).slice(a, b - a)
                    writer.add(own.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(own.is_null()), counts + 1, np.insert(ids, np.cumsum(counts), np.uint32(end_id)))
                    n_docs, n_ids = n_docs + b - a, n_ids + len(ids) + b - a
                batch = next(batches, None)
            writer.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    dealt = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    dealt = dealt.repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
    return cut(dealt.mapInArrow(lambda b: given_back(write(b)), "part long, path string, n_docs long, n_ids long"))


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(path) as source:
                    reader, rows = PlaneReader(source), []
                    for doc_id, ids in reader.documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    placed = files.select("path", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("start"))
    n = max(1, files.count())
    return placed.repartition(n).mapInArrow(lambda b: given_back(read(b)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_planes(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, **options) -> DataFrame:
    """Writes the documents' ids to files in ``folder`` (a new one in the shared folder) and reads them back."""
    return read_tokens(write_tokens(docs, tokenizer, folder or shared_path(docs.sparkSession, "tokens"), end_id, **options))
