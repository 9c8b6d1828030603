"""What stands at the head of a patient's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.text import clean_text, spell_number
from pagegraph.operators.linkage import majority

# How many diagnoses are listed, and how the statement of capture ends.
MOST_DIAGNOSES = 5
REVIEWED = "All information has been reviewed and summarized below as necessary."
MOST_EXAMPLES, EXCERPT = 6, 200


def diagnoses(evidence: DataFrame, keys: list[str], order: str, most: int = MOST_DIAGNOSES) -> DataFrame:
    """The first few different diagnoses of each group, without regard to case, joined by commas."""
    text = F.regexp_replace(F.trim("text"), r"\.+$", "")
    named = evidence.where(F.col("kind") == "diagnosis").select(*keys, text.alias("text"), F.col(order).alias("_at")).where("text <> ''")
    once = named.groupBy(*keys, F.lower("text").alias("_k")).agg(F.min_by("text", "_at").alias("text"), F.min("_at").alias("_at"))
    first = once.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).where(F.col("_n") <= most)
    lists = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", "text"))).alias("l"))
    return lists.select(*keys, F.array_join(F.transform("l", lambda x: x["text"]), ", ").alias("diagnoses"))


def header_fields(entries: DataFrame, keys: list[str], fields: list[str], order: str, first_document: Column) -> DataFrame:
    """Each field as the first document has it, else its most frequent value."""
    def early(f: str) -> Column:
        ok = first_document & F.col(f).isNotNull() & (F.col(f) != "")
        return F.min_by(F.when(ok, F.col(f)), F.when(ok, F.col(order)))

    out = entries.groupBy(*keys).agg(*[early(f).alias(f) for f in fields])
    for f in fields:
        usual = majority(entries, keys, f, order, longest=False).withColumnRenamed(f, f"_{f}")
        out = out.join(usual, keys, "left").withColumn(f, F.coalesce(f, f"_{f}")).drop(f"_{f}")
    return out


def name_variants(entries: DataFrame) -> DataFrame:
    """For each name of a file, its number of places, the first few of them, and an excerpt of the first."""
    names = entries.select("file_id", "entry_seq", "raw_text_excerpt", F.explode(F.array("author", "recipient")).alias("name")).where("name is not null and trim(name) <> ''")
    w = Window.partitionBy("file_id", "name").orderBy("entry_seq")
    ranked = names.withColumn("_n", F.row_number().over(w))
    shown = ranked.where(F.col("_n") <= MOST_EXAMPLES).groupBy("file_id", "name").agg(F.array_sort(F.collect_list("entry_seq")).alias("places"), F.min_by("raw_text_excerpt", "entry_seq").alias("_x"))
    counts = names.groupBy("file_id", "name").agg(F.count("*").alias("n"))
    return shown.join(counts, ["file_id", "name"]).select("file_id", "name", "n", "places", F.left(clean_text(F.col("_x")), F.lit(EXCERPT)).alias("excerpt"))


def capture_statement(pages: Column, first: Column, last: Column, patients: Column) -> Column:
    """How many pages there are, and, if there are several patients, which ones are this one's (T23); blank without pages."""
    words = spell_number(pages)
    head = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1000), F.when(pages == 1, " page has").otherwise(" pages have"), F.lit(" been provided."))
    own = F.when(first == last, F.concat(F.lit("Page "), first.cast("string"), F.lit(" relates to this claimant."))).otherwise(F.concat(F.lit("Pages "), first.cast("string"), F.lit(" to "), last.cast("string"), F.lit(" relate to this claimant.")))
    several = (patients > 1) & (F.coalesce(first, F.lit(0)) > 0) & (F.coalesce(last, F.lit(0)) > 0)
    return F.when(F.coalesce(pages, F.lit(0)) <= 0, "").otherwise(F.concat_ws(" ", head, F.when(several, own), F.lit(REVIEWED)))
