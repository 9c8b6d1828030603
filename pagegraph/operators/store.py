"""Tables of files and jobs: latest rows, content keys, orphans, trees, top lists, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, ENDED = ("queued", "processing"), ("completed", "failed", "cancelled")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first by this order (J09, C10). Spark cuts each partition to its first rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """table with the changes; of rows with one key the last updated stays, a change before what was there."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return latest(both, keys, F.col(updated).desc(), F.col("_new").desc()).drop("_new")


def by_content(rows: DataFrame, content: str, key: str) -> DataFrame:
    """rows with digest, the first key with the same content, and how many have it.

    Groups are counted before they are joined, so a content that very many rows share is no hot partition of rows.
    """
    keyed = rows.withColumn("digest", F.sha2(F.col(content), 256))
    groups = keyed.groupBy("digest").agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))
    return keyed.join(groups, "digest")


def orphans(rows: DataFrame, users: DataFrame, key: str, user_key: str) -> DataFrame:
    """rows that nothing refers to."""
    return rows.join(users.select(F.col(user_key).alias(key)), key, "left_anti")


def in_use(rows: DataFrame, users: DataFrame, key: str, user_key: str) -> DataFrame:
    """rows that something refers to."""
    return rows.join(users.select(F.col(user_key).alias(key)), key, "left_semi")


def top_recent(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows in this order."""
    return rows.orderBy(*order).limit(n)


def page_of(rows: DataFrame, offset: int, size: int, *order: Column) -> DataFrame:
    """A page of rows in a stated order, between 1 and 200 of them."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(200, max(1, size)))


def browse(files: DataFrame, folder_id: str | None) -> DataFrame:
    """Uploaded files of a folder; none is the root."""
    return files.where(F.col("folder_id").eqNullSafe(F.lit(folder_id).cast("string")) & (F.col("source_kind") == "upload")).orderBy(F.col("updated_at").desc(), "name")


def breadcrumbs(folders: DataFrame, levels: int = 32) -> DataFrame:
    """id, depth and path of names from the root of each folder.

    Each round joins the paths found so far with the folders one level down; it ends when no folder is left, and a
    cycle or a tree deeper than ``levels`` is an error rather than a loop.
    """
    found = folders.where("parent_id is null").select("id", F.lit(0).alias("depth"), F.array("name").alias("path"))
    level = found
    for _ in range(levels):
        below = level.select(F.col("id").alias("parent_id"), "depth", "path").join(folders, "parent_id").select("id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("name")).alias("path"))
        if below.isEmpty():
            return found
        found, level = found.unionByName(below), below
    raise ValueError(f"folders nest deeper than {levels} levels, or in a circle")


def find_job(jobs: DataFrame, digest: str, config_id: str | None, version: int | None) -> DataFrame:
    """The newest job of this content under this configuration, of equally new ones the least job_id."""
    return jobs.where((F.lower(F.trim("source_digest")) == digest.strip().lower()) & F.col("rule_config_id").eqNullSafe(F.lit(config_id).cast("string")) & F.col("rule_config_version").eqNullSafe(F.lit(version).cast("bigint"))).orderBy(F.col("updated_at").desc(), "job_id").limit(1)


def submission(jobs: DataFrame) -> Column:
    """What to do when the content comes again: reuse, clone, requeue or new."""
    return F.when(jobs["status"].isin(*ACTIVE), "reuse").when((jobs["status"] == "completed") & jobs["has_artifacts"], "clone").when((jobs["status"] == "failed") & jobs["has_source"], "requeue").otherwise("new")


def deletion_set(jobs: DataFrame, job_id: str) -> DataFrame:
    """The job, and ended jobs of the same content."""
    own = jobs.where(F.col("job_id") == job_id).select(F.col("source_digest").alias("_d"))
    same = jobs.where(F.col("status").isin(*ENDED)).join(own, F.col("source_digest") == F.col("_d"), "left_semi")
    return same.unionByName(jobs.where(F.col("job_id") == job_id)).dropDuplicates(["job_id"])


def recovered(jobs: DataFrame) -> DataFrame:
    """After a restart, jobs that were under way are queued again."""
    return jobs.withColumn("status", F.when(F.col("status").isin(*ACTIVE), "queued").otherwise(F.col("status")))


def with_columns_added(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with columns that a newer schema has, null where missing (C11)."""
    return rows.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in rows.columns})
