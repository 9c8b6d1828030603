"""Entries to scored documents: printed runs, patients carried forward, segments, documents, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.operators.checks import broken_pagination, quality
from pagegraph.operators.segments import segment_dated, segment_documents
from pagegraph.plans.shapes import shape


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document of each file, with its score and the reasons for it."""
    entries = segment_dated(shape(spark, sf_dir, "entries"))
    docs = segment_documents(entries).join(broken_pagination(entries.where("segment is not null")), ["file_id", "segment"], "left")
    docs = docs.withColumns({"n_pages": F.col("page_end") - F.col("page_start") + 1, "n_first_hand": F.col("n_evidence"), "convention_resolved": F.lit(True)})
    scored = quality(docs)
    return scored.select("file_id", "doc_id", "date", "author", "title", "bucket", "patient_key", "page_start", "page_end", "include", "score", "reasons", "needs_review")
