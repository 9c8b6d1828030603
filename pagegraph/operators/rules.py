"""Rules of document types, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The rule type that catches what no other rule does, and a bucket that rules know by another name.
CATCH_ALL = "other"
ALIASES = {"admin": "administrative"}

# Ceilings of words by kind of text, and how far over one is an error.
CEILINGS = {"clinical": 150, "imaging": 50, "functional": 200}
OTHER_CEILING, ERROR_FACTOR = 90, 1.2


def rule_for(documents: DataFrame, rules: DataFrame, *, custom_type: str = "custom_type", bucket: str = "bucket") -> DataFrame:
    """documents with the rule that holds for them: of their own type, else of their bucket, else the catch-all.

    Rules are a list that people keep by hand; each tier is an equality join on their first rule by sort order.
    """
    first = rules.groupBy(F.lower(F.trim("document_type")).alias("_type")).agg(F.min_by(F.struct(*[F.col(c) for c in rules.columns]), F.struct("sort_order", "rule_id")).alias("_rule"))
    alias = F.col(f"`{bucket}`")
    for name, other in ALIASES.items():
        alias = F.when(F.lower(alias) == name, F.lit(other)).otherwise(alias)
    tiers = (F.lower(F.trim(F.col(f"`{custom_type}`"))), F.lower(F.trim(alias)), F.lit(CATCH_ALL))
    out = documents
    for k, key in enumerate(tiers):
        side = first.select(F.col("_type").alias(f"_t{k}"), F.col("_rule").alias(f"_r{k}"))
        out = out.join(side, key == F.col(f"_t{k}"), "left").drop(f"_t{k}")
    tier = F.when(F.col("_r0").isNotNull(), 0).when(F.col("_r1").isNotNull(), 1).when(F.col("_r2").isNotNull(), 2)
    return out.withColumns({"tier": tier, "rule": F.coalesce("_r0", "_r1", "_r2")}).drop("_r0", "_r1", "_r2")


def document_action(rule_action: Column, has_config: Column, bucket: Column) -> Column:
    """The rule's action, else skip for pathology where there are no rules at all, else extract (P10)."""
    return F.coalesce(rule_action, F.when(~has_config & (bucket == "pathology"), F.lit("skip")), F.lit("extract"))


def series_count(documents: DataFrame) -> DataFrame:
    """How many documents of the file have the same bucket and author; those without an author stand alone."""
    author = F.lower(F.trim(F.coalesce("author", F.lit(""))))
    key = F.when(author == "", F.concat(F.lit("#"), F.col("doc_pos"))).otherwise(author)
    return documents.withColumn("series_count", F.count("*").over(Window.partitionBy("file_id", "bucket", key)))


def word_ceiling(override: Column, rule_words: Column, config_words: Column, ladder: Column) -> Column:
    """The rule's ceiling if it overrides, else the configuration's, else one by size."""
    return F.coalesce(F.when(override, rule_words), config_words, ladder)


def ceiling_check(entries: DataFrame, words: Column, kind: str) -> DataFrame:
    """severity of each entry over its kind's ceiling: warning, or error from 1.2 times it."""
    ceiling = F.lit(OTHER_CEILING)
    for name, most in CEILINGS.items():
        ceiling = F.when(F.col(kind) == name, most).otherwise(ceiling)
    checked = entries.withColumns({"words": words, "ceiling": ceiling})
    return checked.where("words > ceiling").withColumn("severity", F.when(F.col("words") <= F.col("ceiling") * ERROR_FACTOR, "warning").otherwise("error"))


def usage_counts(types: DataFrame, rules: DataFrame) -> DataFrame:
    """types with the number of rules of each, by name in lower case."""
    used = rules.groupBy(F.lower("document_type").alias("_k")).agg(F.count("*").alias("_n"))
    return types.join(used, F.lower("name") == F.col("_k"), "left").select(*types.columns, F.coalesce("_n", F.lit(0)).cast("bigint").alias("used"))


def config_with_rules(configs: DataFrame, rules: DataFrame) -> DataFrame:
    """configs with their rules in order."""
    own = rules.groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "rule_id", "document_type"))).alias("rules"))
    return configs.join(own, "config_id", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<struct<sort_order:int,rule_id:string,document_type:string>>")))


def set_default(configs: DataFrame, config_id: str) -> DataFrame:
    """Exactly one default."""
    return configs.withColumn("is_default", F.col("config_id") == config_id)


def delete_config(configs: DataFrame, config_id: str) -> DataFrame:
    """Without one configuration; if it was the default, a seeded one, else the oldest, takes its place; the last one stays."""
    everyone = Window.partitionBy(F.lit(0))
    left = configs.where((F.col("config_id") != config_id)).withColumn("_have", F.max("is_default").over(everyone))
    heir = F.min_by("config_id", F.struct((~F.col("is_seeded")).alias("own"), "created_at", "config_id")).over(everyone)
    promoted = left.withColumn("is_default", F.when(F.col("_have"), F.col("is_default")).otherwise(F.col("config_id") == heir)).drop("_have")
    alone = configs.where(F.col("config_id") == config_id).join(configs.where(F.col("config_id") != config_id).limit(1).select(F.lit(1).alias("_x")), how="left_anti", on=F.lit(True))
    return promoted.unionByName(alone)


def insert_missing(known: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """known, and the wanted rows that it does not have yet, by the key in lower case."""
    clean = wanted.withColumn(key, F.trim(F.regexp_replace(key, r"\s+", " "))).where(F.col(key) != "")
    fresh = clean.withColumn("_k", F.lower(key)).dropDuplicates(["_k"]).join(known.select(F.lower(key).alias("_k")).distinct(), "_k", "left_anti").drop("_k")
    return known.unionByName(fresh, allowMissingColumns=True)


def checked_rules(rules: DataFrame) -> DataFrame:
    """rules with what is wrong with each: blank or long type, words out of range, too many in a configuration."""
    n = F.count("*").over(Window.partitionBy("config_id"))
    tests = {"blank_type": F.coalesce(F.trim("document_type"), F.lit("")) == "", "long_type": F.length("document_type") > 120, "max_words": F.col("max_words").isNotNull() & ~F.col("max_words").between(10, 2000), "too_many": n > 50}
    return rules.withColumn("faults", F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull()))
