"""Line dedup by winnowing: repeated runs of lines are deleted where they come later.

A run of ``lines`` or more lines that also occurs earlier, in an earlier document by doc_id or further up in the
same one, is deleted; so is a run of fewer lines where each has ``long`` characters or more. Of the hashes of each
window of ``lines`` lines, the least (the last of equals) is a fingerprint; a long line is one by itself. Any run that
counts and occurs twice has the same fingerprints, at the same places of it.

Only these fingerprints are stored, each with its position and the hashes of the lines around it. Fingerprints at one
position only are dropped. Those that are left are extended both ways, to the windows that chose them: a window whose lines are those of an earlier one is part of a repeat, and windows that meet are
one run. A window is compared with the first equal one alone, so hot lines make rows, not pairs; both sides of the
joins come straight from exchanges, so Spark can split a hot line. Only DataFrame functions are used.

Edge cases: a null text is one empty line; a text of fewer lines than ``lines`` can lose long lines only. Documents
are ordered by doc_id, null last; rows with the same doc_id and text are one document, and get the same result.
An empty table gives an empty result. Other columns pass through ``line_dedup``; those named like a result
column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.llm._shared import cut, text_of

LINES = 3
#: Characters of a line that counts by itself; lines of 50 words have that many in all but odd cases.
LONG = 200


def _lines(text: str) -> Column:
    return F.split(text_of(text), "\n", -1)


def _chosen(window: Column, lines: int) -> Column:
    """Which line of a window is its fingerprint, from 0."""
    return (lines - F.array_position(F.reverse(window), F.array_min(window))).cast("int")


def fingerprints(docs: DataFrame, lines: int = LINES, long: int = LONG, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), at, fingerprint, lines (1: a long line), and around: the hashes of the lines near it, and how many stand before."""
    each = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("mark"), _lines(text).alias("x"))
    alone = F.filter(F.transform("x", lambda x, i: F.when(F.length(x) >= long, -1 - i)), lambda i: i.isNotNull())
    starts = F.when(F.size("x") >= lines, F.sequence(F.lit(0), F.size("x") - lines)).otherwise(F.array().cast("array<int>"))
    each = each.select("doc_id", "mark", F.transform("x", lambda x: F.xxhash64(x)).alias("h"), F.concat(starts, alone).alias("starts"))
    h, at = F.col("h"), F.col("start")
    # A window that chose the same line as the one before it adds nothing; a number below 0 is that of a long line.
    place = F.when(at < 0, -1 - at).otherwise(at + _chosen(F.slice(h, F.greatest(at, F.lit(0)) + 1, lines), lines))
    before = F.when(at > 0, at - 1 + _chosen(F.slice(h, F.greatest(at, F.lit(1)), lines), lines))
    rows = each.select("doc_id", "mark", "h", F.explode("starts").alias("start")).select("doc_id", "mark", "h", "start", place.alias("at"), before.alias("before"))
    rows = rows.where(F.col("before").isNull() | (F.col("before") != F.col("at")))
    left = F.when(F.col("start") < 0, 0).otherwise(F.least("at", F.lit(lines - 1)))
    around = F.slice(h, F.col("at") - left + 1, F.when(F.col("start") < 0, 1).otherwise(left + lines))
    return rows.select("doc_id", "mark", "at", F.get(h, F.col("at")).alias("fingerprint"), F.when(F.col("start") < 0, 1).otherwise(lines).alias("lines"), around.alias("around"), left.alias("left"))


def _extended(rows: DataFrame) -> DataFrame:
    """doc_id, mark, at, lines and two hashes of each window, or long line, whose fingerprint is among rows."""
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("around") - F.col("lines"))).alias("k"))
    rows = rows.select("*", F.slice("around", F.col("k") + 1, F.col("lines")).alias("own"))
    rows = rows.where(F.col("k") + _chosen(F.col("own"), F.col("lines")) == F.col("left"))
    return rows.select("doc_id", "mark", (F.col("at") - F.col("left") + F.col("k")).alias("at"), "lines", F.xxhash64("own").alias("whole"), F.xxhash64(F.lit(7), F.reverse("own")).alias("check")).distinct()


def repeated_runs(docs: DataFrame, lines: int = LINES, long: int = LONG, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark, first and last line (from 0) of each run to delete."""
    rows = cut(fingerprints(docs, lines, long, doc_id, text))
    position = F.xxhash64("doc_id", "mark", "at")
    again = cut(rows.groupBy("fingerprint").agg(F.min(position).alias("a"), F.max(position).alias("b")).where("a <> b").select("fingerprint"))
    near = cut(_extended(rows.join(again, "fingerprint")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "at")
    first = cut(near.groupBy("whole", "check", "lines").agg(F.min(order).alias("first"), F.max(order).alias("final")).where("first <> final").drop("final"))
    later = near.join(first, ["whole", "check", "lines"]).where(order > F.col("first")).select("doc_id", "mark", "at", (F.col("at") + F.col("lines")).alias("end"))
    in_order = Window.partitionBy("doc_id", "mark").orderBy("at", "end")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(before.isNull() | (F.col("at") > before), 1).otherwise(0)
    runs = later.withColumn("begins", begins).withColumn("run", F.sum("begins").over(in_order))
    return runs.groupBy("doc_id", "mark", "run").agg(F.min("at").alias("first"), (F.max("end") - 1).alias("last")).drop("run")


def line_dedup(docs: DataFrame, lines: int = LINES, long: int = LONG, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text without the deleted runs, n_lines, n_removed and runs (first and last line of each)."""
    found = repeated_runs(docs, lines, long, doc_id, text).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_runs"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "_runs")
    joined = docs.join(found, F.col(f"`{doc_id}`").eqNullSafe(F.col("_id")) & (F.xxhash64(text_of(text)) == F.col("_mark")), "left")
    runs = F.coalesce("_runs", F.array().cast("array<struct<first:int,last:int>>"))
    removed = F.aggregate(runs, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    left = F.filter(_lines(text), lambda x, i: ~F.exists(runs, lambda r: (i >= r["first"]) & (i <= r["last"])))
    taken = {text, "n_lines", "n_removed", "runs"}
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in taken]
    whole = F.when(F.col("_runs").isNull(), text_of(text)).otherwise(F.array_join(left, "\n"))
    return joined.select(*kept, whole.alias(text), F.size(_lines(text)).alias("n_lines"), removed.alias("n_removed"), runs.alias("runs"))
