"""WARC archives of zstandard frames: one frame for each record, all with the dictionary at the head of the file.

A file begins with a skippable frame that holds the dictionary, which is trained on the first records of the
file, up to ``SAMPLE_BYTES`` of them; every record is a frame of its own, so it can be read without the ones
before it. A new file begins after ``FILE_BYTES`` of payload. Payloads of at least ``REVISIT_BYTES`` that are
equal (SHA-256 and length) are stored once: the record of the largest page_id is the response, and the others are
revisits that refer to it and keep its HTTP header, so the payload's length and digest are known of them too.

Files go to the shared folder and get their names when they are whole; a task that runs again writes the same
file anew.

Edge cases: a null payload is empty; a null URL leaves out the target; control characters and blanks in a URL are
percent-encoded; a null page_id gives a record without number, and a response if no equal payload has one;
repeated rows with the largest page_id are responses, all of them; an empty table gives no files and no rows;
other columns are not used.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.llm._files import opened, written
from pagegraph.llm._shared import cut, given_back, shared_path, small, text_of

#: Fixed values of the formats: magic numbers of the dictionary's skippable frame and of a frame, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_BYTES = 1000
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
FILE_BYTES = 256 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
_ID = "urn:pagegraph:page:"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record: a response, or a revisit of the record of page ``refers_to``."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: {digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest (hex) and payload (None for a revisit) of a record.

    Raises ValueError where the record's length or digest is not what it says.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record, or cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its header says")

    def number(name: str) -> int | None:
        text = fields.get(name, "").strip("<>").removeprefix(_ID)
        return int(text) if text else None

    return {"page_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to"), "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None}


def dictionary_of(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there is too little to train on, the last bytes of the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class WarcWriter:
    """Writes records to a stream. The dictionary is built when enough of them have come."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.level, self.held, self.n_held, self.pack = out, level, [], 0, None

    def add(self, data: bytes) -> None:
        if self.pack:
            self.out.write(self.pack(data))
            return
        self.held.append(data)
        self.n_held += len(data)
        if self.n_held >= SAMPLE_BYTES:
            self._start()

    def _start(self) -> None:
        raw = dictionary_of(self.held)
        stored = zstandard.ZstdCompressor(level=19).compress(raw)
        self.out.write(DICTIONARY_MAGIC.to_bytes(4, "little") + len(stored).to_bytes(4, "little") + stored)
        known = zstandard.ZstdCompressionDict(raw)
        known.precompute_compress(level=self.level)
        self.pack = zstandard.ZstdCompressor(dict_data=known, write_content_size=True, write_checksum=True).compress
        for data in self.held:
            self.out.write(self.pack(data))
        self.held = []

    def close(self) -> None:
        if not self.pack:
            self._start()


def records_of(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a file, one after the other; holds one of them."""
    head = source.read(8)
    if int.from_bytes(head[:4], "little") != DICTIONARY_MAGIC:
        raise ValueError("the file does not begin with a dictionary")
    raw = source.read(int.from_bytes(head[4:], "little"))
    if int.from_bytes(raw[:4], "little") == FRAME_MAGIC:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    left = source.read(chunk)
    while left:
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not left and not (left := source.read(chunk)):
                raise ValueError("the file is cut off")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(parts)
        left = left or source.read(chunk)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload and refers_to: the page that has the equal payload's response, null for responses."""
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), text_of(payload).alias("payload"))
    key = F.when(F.octet_length("payload") >= least, F.concat_ws(":", F.octet_length("payload"), F.sha2("payload", 256)))
    keyed = rows.withColumn("key", key)
    again = keyed.select("page_id", "key").where("key is not null").groupBy("key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = keyed.join(small(cut(again)), "key", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_warc(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows of page_id, url, payload and refers_to; gives path and n_records of each file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files = TaskContext.get().partitionId(), []
        source = ((b, i) for b in batches for i in range(b.num_rows))
        item = next(source, None)
        while item is not None:
            path, n, size = f"{folder}/part-{part:06d}-{len(files):04d}.warc.zst", 0, 0
            with written(path) as out:
                writer = WarcWriter(out)
                while item is not None and size < FILE_BYTES:
                    page_id, url, payload, refers_to = (c[item[1]].as_py() for c in item[0].columns)
                    data = payload.encode()
                    writer.add(record(page_id, url, data, refers_to))
                    n, size = n + 1, size + len(data)
                    item = next(source, None)
                writer.close()
            files.append((path, n))
        if files:
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files]), pa.array([f[1] for f in files], pa.int64())], ["path", "n_records"])

    return cut(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(lambda b: given_back(write(b)), "path string, n_records long"))


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_warc(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row for each record of the files (column path), one task for each file."""
    schema = _READ if with_payload else pa.schema([f for f in _READ if f.name != "payload"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as source:
                    rows, size = [], 0
                    for data in records_of(source):
                        rows.append(parsed(data))
                        size += len(data)
                        if len(rows) == 5000 or size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    return files.select("path").repartition(max(1, files.count())).mapInArrow(lambda b: given_back(read(b)), ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema))


def archive(pages: DataFrame, folder: str | None = None, with_payload: bool = False, **columns) -> DataFrame:
    """Writes pages to archives in ``folder`` (a new one in the shared folder) and reads them back."""
    rows = with_revisits(pages, **columns)
    return read_warc(write_warc(rows, folder or shared_path(pages.sparkSession, "warc")), with_payload)
