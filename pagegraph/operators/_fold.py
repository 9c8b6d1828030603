"""Folds over files in Python, for what depends on order and on comparisons that Spark has no function for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

_KINDS = {"integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def per_file(rows: DataFrame, order: str, needed: list[str], name: str, kind: str, fold: Callable[[list[dict]], list]) -> DataFrame:
    """rows with one more column, which ``fold`` makes of all rows of a file, in order; it sees the needed columns.

    Rows are dealt out and sorted by file, so files follow each other and only one of them is held at a time; Arrow
    batches go through as they are, without a call or a frame for each file.
    """

    def finished(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(c).to_pylist() for c in needed]
        records = [dict(zip(needed, values, strict=True)) for values in zip(*columns, strict=True)]
        made: list = []
        for _, group in groupby(zip(batch.column("file_id").to_pylist(), records, strict=True), key=lambda x: x[0]):
            made += fold([r for _, r in group])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, _KINDS[kind])], [*batch.schema.names, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("file_id")
            last = ids[batch.num_rows - 1]
            same = pc.equal(ids, last) if last.is_valid else pc.is_null(ids)
            cut = batch.num_rows - pc.sum(same).as_py()  # rows are sorted by file, so the last file's are at the end
            if cut or (held and held[-1].column("file_id")[0] != last):
                yield from whole([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        yield from whole(held)

    def whole(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is made of these rows, which are joined once."""
        for batch in pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []:
            if batch.num_rows:
                yield finished(batch)

    schema = type(rows.schema)([*rows.schema.fields]).add(name, kind)
    return rows.repartition("file_id").sortWithinPartitions("file_id", order).mapInArrow(run, schema)
