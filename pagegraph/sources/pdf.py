"""Pages of PDF files (S01, S02), if a PDF library is installed; the rest of the engine does not need one."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:
    import pypdf
except ImportError:  # an optional extra
    pypdf = None


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, page_number (from 1), page_count and text of every page; a file that cannot be read has one row with an error."""
    if pypdf is None:
        raise RuntimeError("reading PDF files takes the package pypdf")
    library = pypdf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "page_number", "page_count", "text", "error"]
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages = library.PdfReader(io.BytesIO(content)).pages
                    rows = [(where, k, len(pages), page.extract_text() or "", None) for k, page in enumerate(pages, 1)]
                except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                    rows = [(where, None, None, None, str(e)[:200])]
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, page_number int, page_count int, text string, error string")
