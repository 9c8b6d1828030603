"""Exact dedup: a tree-merge of sorted runs of digests, which partitions exchange in binomial rounds.

Every partition makes a run of its rows: one entry for each digest, with the number of rows and the row that would
stay. In a round, ``fan_in`` neighbouring runs meet and divide the digests among themselves, so each of the new,
longer runs lies in ``fan_in`` times as many ranges. Entries go to the task of their run and range, lie there in
order of digest, and those of one digest, one from each run at most, become one. Rounds end when all runs have met.
The number of tasks of a round is about that of the first runs, and a hot text is never more than ``fan_in`` entries
in a task, however many rows have it.

An entry is merged only with entries of the same SHA-256, XXH64 and length of the normalised text, at every level;
that is what verified means here, texts are not compared. The plan is built from DataFrame functions alone: an
exchange by run and range, a sort, and a sorted aggregate in each round.

Edge cases: a null text is an empty one. Of equal texts the one with most code points stays, then the
smallest doc_id, null last. Repeated rows with the same doc_id are one document: all of them are marked kept
if that doc_id stays. An empty table gives an empty result. Columns other than doc_id and text are not used;
those named like a result column do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.llm._shared import BLANKS, cut, text_of

#: Runs that meet in one round.
FAN_IN = 8


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.translate(text, BLANKS, "")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_points, and the key of the normalised text: sha, check, n_solid."""
    bare = normalised(text_of(text))
    return docs.select(F.col(doc_id).alias("doc_id"), F.length(text_of(text)).alias("n_points"), F.sha2(bare, 256).alias("sha"), F.xxhash64(bare).alias("check"), F.length(bare).alias("n_solid"))


_KEY = ("sha", "check", "n_solid")


def merged_runs(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each key: n rows, and the largest of the structs in ``rank``. ``rows`` has to be written out (see ``cut``), since its partitions are the runs."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = (rows.select(F.spark_partition_id().alias("run")).agg(F.max("run")).first()[0] or 0) + 1
    entries = (F.sum("n").alias("n"), F.max("rank").alias("rank"))
    level, ranges = rows.select(F.spark_partition_id().alias("run"), *_KEY, F.lit(1).cast("bigint").alias("n"), "rank").groupBy("run", *_KEY).agg(*entries), 1
    place = F.conv(F.substring("sha", 1, 8), 16, 10).cast("bigint")
    while left > 1:
        left, ranges = -(-left // fan_in), ranges * fan_in
        met = level.select(F.floor(F.col("run") / fan_in).cast("int").alias("run"), F.shiftright(place * ranges, 32).cast("int").alias("range"), *_KEY, "n", "rank")
        # Dealt by run and range, the entries of a digest are together, so the aggregate needs no exchange of its own.
        level = met.repartition(tasks, "run", "range").sortWithinPartitions("run", "range", *_KEY).groupBy("run", "range", *_KEY).agg(*entries)
    return level.select(*_KEY, "n", "rank")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows = cut(digests(docs, doc_id, text))
    rank = F.struct(F.col("n_points"), F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("inverse")).alias("rank")
    best = merged_runs(rows.select(*_KEY, rank)).select(*_KEY, "n", F.bitwise_not(F.col("rank")["inverse"]).alias("keep_id"))
    joined = rows.join(best, [*_KEY])
    return joined.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
