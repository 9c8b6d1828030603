"""Scoring of results against an answer key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions.text import clean_text


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.lower(clean_text(text))


def missing_pages(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """Pages 1 to page_count of each file that no entry's range has."""
    got = entries.groupBy("file_id").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("page_start", "page_end")))).alias("got"))
    gaps = counts.join(got, "file_id", "left").select("file_id", F.explode(F.array_except(F.sequence(F.lit(1), F.col("page_count")), F.coalesce("got", F.array().cast("array<int>")))).alias("page"))
    return gaps


def overlaps(entries: DataFrame, key: DataFrame, fields: list[str]) -> DataFrame:
    """For each document of the key, the entries whose pages meet its own, and which fields any of them has right.

    The ranges of one file are compared, never those of two.
    """
    e, k = entries.alias("e"), key.alias("k")
    meet = (F.col("e.file_id") == F.col("k.file_id")) & (F.col("e.page_start") <= F.col("k.page_end")) & (F.col("e.page_end") >= F.col("k.page_start"))
    joined = k.join(e, meet, "left")
    right = [F.coalesce(F.max(F.col(f"e.{f}").eqNullSafe(F.col(f"k.{f}"))), F.lit(False)).alias(f"{f}_ok") for f in fields]
    return joined.groupBy("k.file_id", "k.key_id").agg(F.count("e.file_id").alias("n_entries"), *right)


def page_traps(entries: DataFrame, traps: DataFrame) -> DataFrame:
    """trap_id and failed of three kinds of trap: at most n documents on a page, pages in one document, pages in separate ones."""
    on_page = entries.select("file_id", "entry_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    asked = traps.select("file_id", "trap_id", "kind", "most", F.explode("pages").alias("page"))
    met = asked.join(on_page, ["file_id", "page"], "left").groupBy("file_id", "trap_id", "kind", "most").agg(F.count_distinct("entry_id").alias("n"), F.count_distinct("page").alias("pages"), F.count("entry_id").alias("hits"))
    failed = F.when(F.col("kind") == "max_documents", F.col("n") > F.col("most")).when(F.col("kind") == "same_document", F.col("n") > 1).when(F.col("kind") == "separate_documents", F.col("n") < F.col("pages"))
    return met.select("file_id", "trap_id", "kind", failed.alias("failed"))


def report(findings: DataFrame, checks: DataFrame) -> DataFrame:
    """score of each file, the share of its checks without a finding, and findings by severity."""
    by_file = findings.groupBy("file_id").agg(F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "error", "warning")])
    joined = checks.join(by_file, "file_id", "left").na.fill(0)
    return joined.withColumn("score", F.greatest(F.lit(0.0), (F.col("checks") - F.col("findings")) / F.col("checks")))


def text_traps(entries: DataFrame, traps: DataFrame) -> DataFrame:
    """file_id, trap_id and kind of the traps about words that entries have fallen into, and how many entries.

    traps: kind (phrase_near_date, forbidden_author, phrase_on_page), date, forbidden (phrases or names) and pages. An
    entry counts once, whichever of the phrases it says. Entries are matched with the traps of their file alone.
    """
    e, t = entries.withColumn("_said", normalised(F.col("text"))).alias("e"), traps.alias("t")
    joined = e.join(t, "file_id")
    on_page = F.exists("t.pages", lambda p: (p >= F.col("e.page_start")) & (p <= F.col("e.page_end")))
    says = F.exists("t.forbidden", lambda w: F.contains(F.col("_said"), F.lower(w)))
    credits = F.exists("t.forbidden", lambda w: F.contains(F.col("_said"), F.concat(F.lit("by "), F.lower(w))))
    caught = F.when(F.col("t.kind") == "phrase_near_date", F.contains(F.col("_said"), F.lower("t.date")) & says).when(F.col("t.kind") == "forbidden_author", on_page & credits).when(F.col("t.kind") == "phrase_on_page", on_page & says)
    return joined.where(caught).groupBy("file_id", "trap_id", "t.kind").agg(F.count("*").alias("n"))


def visible_types(entries: DataFrame, key: DataFrame) -> DataFrame:
    """The types, in lower case, of the entries whose pages meet those of each document of the key."""
    e, k = entries.alias("e"), key.alias("k")
    meet = (F.col("e.file_id") == F.col("k.file_id")) & (F.col("e.page_start") <= F.col("k.page_end")) & (F.col("e.page_end") >= F.col("k.page_start"))
    return k.join(e, meet).groupBy("k.file_id", "k.key_id").agg(F.array_sort(F.collect_set(F.lower(F.coalesce("e.registered_type", F.lit(""))))).alias("types"))


def spanning_entries(entries: DataFrame, traps: DataFrame) -> DataFrame:
    """file_id, trap_id and how many entries have pages of both ranges that belong to separate documents.

    traps: left_start, left_end, right_start and right_end. Traps without such an entry are not listed.
    """
    e, t = entries.alias("e"), traps.alias("t")

    def meets(side: str) -> Column:
        return (F.col("e.page_start") <= F.col(f"t.{side}_end")) & (F.col("e.page_end") >= F.col(f"t.{side}_start"))

    return e.join(t, (F.col("e.file_id") == F.col("t.file_id")) & meets("left") & meets("right")).groupBy("t.file_id", "t.trap_id").agg(F.count("*").alias("n"))
