"""Lists, lookups and projections of the stores.

Lists that a person reads come in a stated order; rank columns say it, so that no order has to survive a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.wording import content_type, distinct_names

ACTIVE = ("queued", "processing")

# Types that the parser itself gives, in the order in which they are listed, and the limits of what is passed on.
BUILTIN_TYPES = ("clinical", "imaging", "pathology", "functional", "administrative")
MOST_EVIDENCE, MOST_FIELDS, TEXT_LAYER, FULL_TEXT = 320, 40, 6000, 12000

#: Fields of a job that only its own page shows.
DETAIL_FIELDS = ("patients", "pipeline", "cost_summary", "payload")


def included(documents: DataFrame) -> DataFrame:
    """Documents that belong in the output."""
    return documents.where(F.coalesce("include", F.lit(False)))


def ordered_jobs(jobs: DataFrame) -> DataFrame:
    """jobs, the last updated first, and by id among equals."""
    return jobs.orderBy(F.col("updated_at").desc_nulls_last(), "job_id")


def jobs_by_cost(jobs: DataFrame) -> DataFrame:
    """Jobs that made calls, the dearest first."""
    return billed(jobs).orderBy(F.coalesce("cost_usd", F.lit(0.0)).desc(), "job_id")


def billed(jobs: DataFrame, since: Column | None = None) -> DataFrame:
    """Jobs that made calls, and were last changed since then."""
    some = jobs.where(F.coalesce("calls", F.lit(0)) > 0)
    return some if since is None else some.where(F.coalesce("updated_at", "created_at") >= since)


def ordered_configs(configs: DataFrame) -> DataFrame:
    """The default first, then by name."""
    return configs.orderBy(F.col("is_default").desc(), "name", "config_id")


def default_config(configs: DataFrame) -> DataFrame:
    """The one that is marked, else the oldest (L07); no row if there is none."""
    return configs.orderBy(F.col("is_default").desc(), "created_at", "config_id").limit(1)


def ordered_types(types: DataFrame, builtin: Sequence[str] = BUILTIN_TYPES) -> DataFrame:
    """types with rank, from 1: the built-in ones in their order, then the others by name."""
    place = F.array_position(F.array(*[F.lit(b) for b in builtin]), F.lower("name"))
    order = Window.orderBy(F.col("is_builtin").desc(), F.when(F.col("is_builtin"), place).otherwise(0), F.when(~F.col("is_builtin"), F.lower("name")).otherwise(""), "name")
    return types.withColumn("rank", F.row_number().over(order))


def suggested_types(builtin: Sequence[str], suggested: Sequence[str], in_use: DataFrame) -> DataFrame:
    """name of each type once, whatever its case, spelled as rules spell it (U05); in_use: rule_ord and document_type."""
    spark = in_use.sparkSession
    listed = spark.createDataFrame([(0, k, n) for k, n in enumerate(builtin)] + [(1, k, n) for k, n in enumerate(suggested)], "tier int, ord long, name string")
    used = in_use.select(F.lit(2).alias("tier"), F.col("rule_ord").cast("long").alias("ord"), F.trim(F.regexp_replace(F.coalesce("document_type", F.lit("")), r"\s+", " ")).alias("name")).where("name <> ''")
    every = listed.unionByName(used)
    spelled = F.coalesce(F.min_by("name", F.when(F.col("tier") == 2, F.col("ord"))), F.min_by("name", F.struct("tier", "ord")))
    named = every.groupBy(F.lower("name").alias("key")).agg(spelled.alias("name"), F.min(F.struct("tier", "ord")).alias("place"))
    return named.select("name", "place.tier", "place.ord")


def first_evidence(evidence: DataFrame, keys: list[str], *order: str, most: int = MOST_EVIDENCE) -> DataFrame:
    """The first items of each group in this order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return evidence.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def first_fields(fields: Column, most: int = MOST_FIELDS) -> Column:
    """The first fields of a page."""
    return F.slice(fields, 1, most)


def clipped(text: Column, most: int = FULL_TEXT) -> Column:
    """A text of limited length."""
    return F.left(text, F.lit(most))


def drive_listing(files: DataFrame) -> DataFrame:
    """Files with rank: the last changed first, those without a time last, then by name."""
    return files.withColumn("rank", F.row_number().over(Window.partitionBy("folder").orderBy(F.col("modified").desc_nulls_last(), "name")))


def in_document_order(documents: DataFrame) -> DataFrame:
    """documents with place, from 1 in a file: by first page, then as they were."""
    return documents.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("page_start", "doc_pos")))


def find_types(types: DataFrame, needle: str) -> DataFrame:
    """Types whose name or description has the needle, in any case; a blank one finds all (P20)."""
    low = needle.strip().lower()
    return types if not low else types.where(F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit(low)))


def extractable(files: DataFrame) -> DataFrame:
    """Files that can be read."""
    return files.where(F.coalesce("can_extract", F.lit(False)))


def job_counts(jobs: DataFrame) -> DataFrame:
    """One row: jobs under way, and jobs that are ready."""
    return jobs.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), F.count_if(F.col("status") == "completed").alias("ready"))


def lookup(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """wanted (key) with found and, as ``row``, the row of that key (P26); an unknown key has found false."""
    side = rows.select(F.col(key), F.struct(*[F.col(c) for c in rows.columns if c != key]).alias("row")).dropDuplicates([key])
    return wanted.join(side, key, "left").select(key, F.col("row").isNotNull().alias("found"), "row")


def decoded_jobs(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Jobs from their JSON payload; what it does not have, and all of one that cannot be read, comes from the flat columns.

    source_file_id of the record counts before the payload's; readable says whether the payload could be read.
    """
    schema = ", ".join(f"{c} {kind}" for c, kind in fields.items())
    parsed = records.withColumn("_p", F.from_json(F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")), schema))

    def value(c: str) -> Column:
        inner, flat = F.col(f"_p.{c}"), (F.col(c) if c in records.columns else F.lit(None))
        return F.coalesce(flat, inner) if c == "source_file_id" else F.coalesce(inner, flat)

    return parsed.select("job_id", *[value(c).cast(kind).alias(c) for c, kind in fields.items()], F.col("_p").isNotNull().alias("readable"))


def job_summaries(jobs: DataFrame) -> DataFrame:
    """jobs without the fields that only their own page shows (X11)."""
    return jobs.drop(*DETAIL_FIELDS)


def file_rows(files: DataFrame, linked: DataFrame) -> DataFrame:
    """Files as the interface shows them, with the newest job of each; prompts and names are never null."""
    joined = files.join(linked.select("file_id", F.col("job_id").alias("linked_job_id"), F.col("status").alias("linked_status")), "file_id", "left")
    return joined.select("file_id", F.coalesce("name", F.lit("")).alias("name"), content_type(F.col("name"), F.col("content_type")).alias("content_type"), F.coalesce("size_bytes", F.lit(0)).cast("bigint").alias("size_bytes"), "linked_job_id", "linked_status")


def job_totals(paragraphs: DataFrame) -> DataFrame:
    """patient_count and document_count of each job, without placeholders."""
    return paragraphs.groupBy("job_id").agg(F.count_distinct("patient").alias("patient_count"), F.count_if(~F.coalesce("is_placeholder", F.lit(False))).alias("document_count"))


def pages_seen(entries: DataFrame) -> DataFrame:
    """How many different pages of each file have been read."""
    return entries.groupBy("file_id").agg(F.count_distinct("page_number").alias("pages"))


def page_progress(entries: DataFrame) -> DataFrame:
    """entries with done, the number of different pages read so far, in the order in which answers came."""
    order = Window.partitionBy("file_id").orderBy("answer_seq")
    fresh = F.row_number().over(Window.partitionBy("file_id", "page_number").orderBy("answer_seq")) == 1
    return entries.withColumn("_fresh", fresh.cast("int")).withColumn("done", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_fresh")


def stored_artifacts(wanted: DataFrame, artifacts: DataFrame, jobs: DataFrame, files: DataFrame, fallback: str = "source_pdf") -> DataFrame:
    """wanted (job_id, name) with the stored object's key and content type; a missing ``fallback`` is taken from the job's file."""
    own = artifacts.select("job_id", "name", F.col("object_key").alias("_own"))
    of_job = jobs.select("job_id", "source_file_id").join(files.select(F.col("file_id").alias("source_file_id"), F.col("object_key").alias("_vault")), "source_file_id").select("job_id", "_vault")
    found = wanted.join(own, ["job_id", "name"], "left").join(of_job, "job_id", "left")
    key = F.coalesce("_own", F.when(F.col("name") == fallback, F.col("_vault")))
    return found.select("job_id", "name", key.alias("object_key"), content_type(F.coalesce(key, "name"), F.lit(None).cast("string")).alias("content_type"), key.isNotNull().alias("found"))


def collapsed_names(rows: DataFrame, key: str, column: str) -> DataFrame:
    """The different names of each group, with single blanks."""
    return rows.groupBy(key).agg(F.array_sort(distinct_names(F.collect_list(column))).alias("names"))
