"""Page entries: filling, expanding, printed runs, identity carried forward.

An entry has file_id and entry_seq, its place in the file. Operators are DataFrame to DataFrame, and each works within
a file, so a file's entries meet in one window partition; a file has some hundred pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.text import pii_scrub

#: Kinds that carry no content of their own.
BARE_KINDS = ("admin", "empty", "signature_only")


def by_file(*order: str) -> Window:
    return Window.partitionBy("file_id").orderBy(*(order or ("entry_seq",)))


def marker_usable(index: Column, total: Column) -> Column:
    """A printed "page i of n" that says something."""
    return F.coalesce((index > 0) & (index <= total) & (total > 1), F.lit(False))


def with_marker_flags(entries: DataFrame) -> DataFrame:
    """usable, is_first and is_continuation of each entry's marker."""
    usable = marker_usable(F.col("marker_index"), F.col("marker_total"))
    return entries.select("*", usable.alias("usable"), (usable & (F.col("marker_index") == 1)).alias("is_first"), (usable & (F.col("marker_index") > 1)).alias("is_continuation"))


def fill_missing_pages(entries: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Every page 1 to page_count of each file has an entry; new ones are empty and left out of output."""
    pages = page_counts.select("file_id", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page_number"))
    filled = pages.join(entries, ["file_id", "page_number"], "left")
    return filled.withColumns({"kind": F.coalesce("kind", F.lit("empty")), "include": F.coalesce("include", F.lit(False)), "missing": F.col("entry_seq").isNull()})


def expand_nested(rows: DataFrame, column: str) -> DataFrame:
    """One row for each element of an array column, with its ordinal from 0."""
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(column).alias("ordinal", column))


def printed_runs(entries: DataFrame) -> DataFrame:
    """entries with run_start, the entry_seq at which its printed run begins, null outside of runs.

    A run is page 1, 2, ... of the same total on entries that follow each other. One that is cut short counts only if
    the next entry is a page 1 or the file ends.
    """
    w, flags = by_file(), with_marker_flags(entries)
    prior = F.lag(F.struct("usable", "marker_index", "marker_total")).over(w)
    linked = F.coalesce(F.col("usable") & prior["usable"] & (prior["marker_total"] == F.col("marker_total")) & (F.col("marker_index") == prior["marker_index"] + 1), F.lit(False))
    islands = flags.withColumns({"_linked": linked, "_next_first": F.lead("is_first").over(w), "_final": F.lead("entry_seq").over(w).isNull()})
    islands = islands.withColumn("_island", F.sum((~F.col("_linked")).cast("int")).over(w))
    run = Window.partitionBy("file_id", "_island")
    end = F.max_by(F.struct((F.col("marker_index") == F.col("marker_total")).alias("whole"), "_next_first", "_final"), "entry_seq").over(run)
    kept = F.col("usable") & (F.min("marker_index").over(run) == 1) & (end["whole"] | F.coalesce(end["_next_first"], F.lit(False)) | end["_final"])
    out = islands.withColumn("run_start", F.when(kept, F.min("entry_seq").over(run)))
    return out.select(*entries.columns, "run_start")


def repair_printed_runs(entries: DataFrame) -> DataFrame:
    """Within a printed run: included if any entry is, content kind for bare ones, the first title, one beginning."""
    runs = printed_runs(entries)
    named = F.trim(F.coalesce("title", F.lit(""))) != ""
    told = ~F.col("kind").isin(*BARE_KINDS)
    # One aggregate for each run; it is dealt by file, as the runs are, and so is the join.
    found = runs.where("run_start is not null").groupBy("file_id", "run_start").agg(F.max("include").alias("_any"), F.min_by(F.when(told, F.col("kind")), F.when(told, F.col("entry_seq"))).alias("_content"), F.min_by(F.when(named, F.col("title")), F.when(named, F.col("entry_seq"))).alias("_title"))
    inside = F.col("run_start").isNotNull()
    fixed = runs.join(found, ["file_id", "run_start"], "left").select(
        *[c for c in entries.columns if c not in ("include", "kind", "title", "starts_new")], "run_start",
        F.when(inside, F.col("_any")).otherwise(F.col("include")).alias("include"),
        F.when(inside & F.col("_any") & F.col("kind").isin("admin", "signature_only"), F.coalesce("_content", "kind")).otherwise(F.col("kind")).alias("kind"),
        F.when(inside & ~named, F.coalesce("_title", "title")).otherwise(F.col("title")).alias("title"),
        F.when(inside, F.col("entry_seq") == F.col("run_start")).otherwise(F.col("starts_new")).alias("starts_new"),
    )
    return fixed.select(*entries.columns, "run_start")


def carry_patient(entries: DataFrame) -> DataFrame:
    """Entries without name and birth date take both, and a missing identifier, from the last entry that had either."""
    w = by_file().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.col("patient_name").isNotNull() | F.col("patient_dob").isNotNull()
    last = F.last(F.when(own, F.struct("patient_name", "patient_dob", "patient_identifier")), ignorenulls=True).over(w)
    return entries.withColumn("_last", last).withColumns({
        "patient_name": F.when(own, F.col("patient_name")).otherwise(F.col("_last.patient_name")),
        "patient_dob": F.when(own, F.col("patient_dob")).otherwise(F.col("_last.patient_dob")),
        "patient_identifier": F.coalesce("patient_identifier", F.when(~own, F.col("_last.patient_identifier"))),
    }).drop("_last")


def scrub_entries(entries: DataFrame) -> DataFrame:
    """Evidence and excerpt without personal data; blank evidence goes, and with it bare entries from output."""
    scrubbed = F.filter(F.transform("evidence", lambda e: e.withField("text", pii_scrub(e["text"]))), lambda e: F.coalesce(e["text"], F.lit("")) != "")
    out = entries.withColumns({"evidence": scrubbed, "raw_text_excerpt": pii_scrub(F.col("raw_text_excerpt"))})
    return out.withColumn("include", F.when(F.col("kind").isin("admin", "empty") & (F.size("evidence") == 0), False).otherwise(F.col("include")))


def uncovered_runs(pages: DataFrame, covered: DataFrame) -> DataFrame:
    """file_id, first and last page of each stretch of pages that nothing covers."""
    open_pages = pages.select("file_id", "page_number").distinct().join(covered, ["file_id", "page_number"], "left_anti")
    return open_pages.withColumn("_g", F.col("page_number") - F.row_number().over(by_file("page_number"))).groupBy("file_id", "_g").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end")).drop("_g")


def chunked(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """chunk, from 0, of ``size`` rows each within a file."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(by_file(*order)) - 1) / size).cast("int"))


def numbered(rows: DataFrame, counts: Column, *order: str) -> DataFrame:
    """document_number: a running count of the rows that count, 0 for the others."""
    running = F.sum(counts.cast("int")).over(by_file(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("document_number", F.when(counts, running).otherwise(F.lit(0)).cast("bigint"))


def within_budget(rows: DataFrame, length: Column, budget: int, *order: str) -> DataFrame:
    """Rows of each file until the lengths before them reach the budget.

    What is before a row in its own partition is before it in the file, so each partition is cut first, and the rows of
    a file that meet in one task are those that the budget may hold from each partition, not the whole file.
    """
    order = order or ("entry_seq",)
    measured = rows.withColumns({"_part": F.spark_partition_id(), "_length": length})

    def before(*keys: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_length").over(w), F.lit(0)).cast("bigint")

    near = measured.withColumn("before", before("file_id", "_part")).where(F.col("before") < budget)
    return near.withColumn("before", before("file_id")).where(F.col("before") < budget).drop("_part", "_length")
