"""Helpers that every operator here uses: the shared folder, checked broadcasts, columns of inputs."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; counted before, and joined by shuffle beyond it.
BROADCAST_ROWS = 50_000

#: The characters that separate words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that goes to a Python worker, where the session does not say: workers hold one batch, and rows may be long.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one made here if all runs in one machine."""
    if spark.conf.get(_BATCH_SETTING) == _default(spark):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="pagegraph-")
        spark.conf.set("spark.checkpoint.dir", known)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


_made: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``cleared`` removes what was written there."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def cleared(spark: SparkSession) -> int:
    """Removes all that this process wrote under ``shared_path``, when its results are no longer read; gives how many paths there were.

    What ``cut`` wrote is Spark's to remove: spark.cleaner.referenceTracking.cleanCheckpoints says whether it does.
    """
    n = len(_made)
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def _default(spark: SparkSession) -> str:
    """What the setting is unless the session has its own."""
    return spark.newSession().conf.get(_BATCH_SETTING)


def given_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; when they end, its worker gives free memory back to the system, since workers live on."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and read again from the shared folder, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))
