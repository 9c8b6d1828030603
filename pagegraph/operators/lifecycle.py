"""Jobs and configurations as tables that change: failing, cancelling, retrying, recovering, snapshots, types.

A job is a row with its steps as an array in their order; a change is a new table, and rows it does not concern stay
as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.text import redact_secrets
from pagegraph.functions.wording import made_id

# States, what is said of a step that ended, and the length to which it is cut; the step that a stage's cost belongs to.
ACTIVE = ("queued", "processing")
CANCELLED = "Job cancelled by user."
STEP_CANCELLED, STEP_STORED, STEP_WAITING, STEP_RESUMES = "Cancelled by user.", "Source document encrypted and stored.", "Waiting for retry.", "Queued to resume after server restart."
DETAIL_CHARS = 200
STAGE_TO_STEP = {"parse": "extract", "summarize": "summary"}


def _steps(change: Callable[[Column], Column]) -> Column:
    return F.transform("steps", change)


def _running_to(status: str, detail: Column) -> Column:
    """The steps, of which those under way get a state and a remark."""
    return _steps(lambda s: F.when(s["status"] == "running", s.withField("status", F.lit(status)).withField("detail", detail)).otherwise(s))


def _changed(jobs: DataFrame, where: Column, **columns: Column) -> DataFrame:
    return jobs.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in columns.items()})


def failed(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """jobs, of which those among failures (job_id, message, kind) are failed, with no secret in what is said."""
    joined = jobs.join(failures.select("job_id", "message", "kind"), "job_id", "left")
    said = F.coalesce(F.nullif(redact_secrets(F.col("message")), F.lit("")), F.col("kind"))
    detail = F.coalesce(F.nullif(F.left(said, F.lit(DETAIL_CHARS)), F.lit("")), F.lit("Failed."))
    return _changed(joined.withColumn("_said", said), F.col("kind").isNotNull(), status=F.lit("failed"), error=F.col("_said"), steps=_running_to("failed", detail)).select(*jobs.columns)


def cancelled(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """jobs, of which those wanted are cancelled, unless they have ended."""
    joined = jobs.join(wanted.select("job_id").distinct().withColumn("_wanted", F.lit(True)), "job_id", "left")
    return _changed(joined, F.col("_wanted") & F.col("status").isin(*ACTIVE), status=F.lit("cancelled"), error=F.lit(CANCELLED), steps=_running_to("failed", F.lit(STEP_CANCELLED))).select(*jobs.columns)


def retried(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """jobs, of which those wanted that still have their source wait again, with all steps but the upload to do."""
    joined = jobs.join(wanted.select("job_id").distinct().withColumn("_wanted", F.lit(True)), "job_id", "left")
    again = _steps(lambda s: F.when(s["key"] == "upload", s.withField("status", F.lit("completed")).withField("detail", F.lit(STEP_STORED))).otherwise(s.withField("status", F.lit("pending")).withField("detail", F.lit(STEP_WAITING))))
    return _changed(joined, F.col("_wanted") & F.col("has_source"), status=F.lit("queued"), error=F.lit(None).cast("string"), steps=again).select(*jobs.columns)


def recovered_jobs(jobs: DataFrame) -> DataFrame:
    """jobs after a restart: those under way wait again, their running steps are to do, and resumed says which."""
    active = F.col("status").isin(*ACTIVE)
    return _changed(jobs.withColumn("resumed", active), active, status=F.lit("queued"), steps=_running_to("pending", F.lit(STEP_RESUMES)))


def step_changed(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """jobs with the state and remark of one step each, from changes (job_id, key, status, detail), the last of each step."""
    last = changes.groupBy("job_id", "key").agg(F.max_by(F.struct("status", "detail"), "seq").alias("to"))
    known = last.groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "to"))).alias("_to"))
    joined = jobs.join(known, "job_id", "left")
    # A job without changes has no map, and its steps stay.
    steps = _steps(lambda s: F.when(F.col("_to")[s["key"]].isNotNull(), s.withField("status", F.col("_to")[s["key"]]["status"]).withField("detail", F.col("_to")[s["key"]]["detail"])).otherwise(s))
    return joined.withColumn("steps", F.when(F.col("_to").isNotNull(), steps).otherwise(F.col("steps"))).select(*jobs.columns)


def cost_breakdown(summary: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row with the totals, by_stage and by_model of a summary at three grains (A02); see ``costs.cost_summary``."""
    parts = ("calls", "input_tokens", "output_tokens", "cached_tokens", "usd")
    whole = F.max(F.when(F.col("stage").isNull() & F.col("model").isNull(), F.struct(*parts)))
    by_stage = F.array_sort(F.collect_list(F.when(F.col("stage").isNotNull(), F.struct("stage", *parts))))
    by_model = F.array_sort(F.collect_list(F.when(F.col("model").isNotNull(), F.struct(F.coalesce("provider", F.lit("")).alias("provider"), "model", *parts))))
    rows = summary.groupBy(*(keys or [])).agg(whole.alias("_t"), by_stage.alias("by_stage"), by_model.alias("by_model"))
    return rows.select(*(keys or []), "_t.*", "by_stage", "by_model")


def step_costs(by_stage: DataFrame, steps: DataFrame) -> DataFrame:
    """steps (job_id, key) with the tokens and cost of the stage that belongs to each, 0 where none does."""
    key = F.lit(None).cast("string")
    for stage, step in STAGE_TO_STEP.items():
        key = F.when(F.col("stage") == stage, step).otherwise(key)
    parts = ("input_tokens", "output_tokens", "usd")
    rolled = by_stage.withColumn("key", key).where("key is not null").groupBy("job_id", "key").agg(*[F.sum(c).alias(c) for c in parts])
    return steps.join(rolled, ["job_id", "key"], "left").select("job_id", "key", *[F.coalesce(c, F.lit(0)).alias(c) for c in parts])


def snapshot(configs: DataFrame, rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """The configuration of each request (request_id, config_id or null) as it is now, with its rules in order.

    A request without a configuration gets the default, or the oldest; one for an unknown configuration gets nothing.
    """
    default = configs.orderBy(F.col("is_default").desc(), "created_at", "config_id").limit(1).select(F.col("config_id").alias("_default"))
    listed = rules.groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct("sort_order", "rule_id", "document_type", "action"))).alias("rules"))
    asked = wanted.join(F.broadcast(default), F.lit(True), "left").select("request_id", F.coalesce("config_id", "_default").alias("config_id"))
    return asked.join(configs.select("config_id", "name", "version"), "config_id").join(listed, "config_id", "left").select("request_id", "config_id", "name", "version", F.coalesce("rules", F.array().cast("array<struct<sort_order:int,rule_id:string,document_type:string,action:string>>")).alias("rules"))


def with_copies(configs: DataFrame, copied: DataFrame) -> DataFrame:
    """configs and a copy of each of those named, called ``name (copy)``, or with the first free number from 2 on after it."""
    mark = r"^(.*) \(copy\)(?: (\d+))?$"
    number = F.coalesce(F.nullif(F.regexp_extract("name", mark, 2), F.lit("")).try_cast("int"), F.lit(1))
    taken = configs.where(F.col("name").rlike(mark)).groupBy(F.regexp_extract("name", mark, 1).alias("name")).agg(F.collect_set(number).alias("_taken"))
    new = configs.join(copied.select("config_id").distinct(), "config_id", "left_semi").join(taken, "name", "left")
    used = F.coalesce("_taken", F.array().cast("array<int>"))
    n = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(used) + 1), used))
    called = F.concat("name", F.lit(" (copy)"), F.when(n == 1, "").otherwise(F.concat(F.lit(" "), n.cast("string"))))
    made = new.select(made_id("rc", F.concat_ws("#", "config_id", n.cast("string"))).alias("config_id"), called.alias("name"), F.lit(1).cast("bigint").alias("version"), F.lit(False).alias("is_default"), "created_at")
    return configs.select("config_id", "name", F.col("version").cast("bigint").alias("version"), "is_default", "created_at").unionByName(made)


def replaced_rules(configs: DataFrame, rules: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """configs and rules after an update: the rules of a changed configuration are replaced whole, in the order given, and its version goes up."""
    ids = changed.select("config_id").distinct()
    numbered = changed.withColumn("sort_order", (F.row_number().over(Window.partitionBy("config_id").orderBy("given")) - 1).cast("int"))
    kept = rules.join(ids, "config_id", "left_anti")
    raised = configs.join(ids.withColumn("_up", F.lit(1)), "config_id", "left").withColumn("version", F.col("version") + F.coalesce("_up", F.lit(0)))
    return raised.select(*configs.columns), kept.unionByName(numbered.select(*rules.columns))


def created_types(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (type_id, name) with accepted: whether no type of that name, in any case, is there before it."""
    known = types.select(F.lower("name").alias("_k")).distinct().withColumn("_there", F.lit(True))
    first = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("type_id")) == 1
    return wanted.withColumn("_first", first).join(known, F.lower(wanted["name"]) == F.col("_k"), "left").select("type_id", "name", (F.col("_first") & F.col("_there").isNull()).alias("accepted"))


def without_types(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """types without those wanted, but with the built-in ones, which stay; rules keep their types as text."""
    gone = types.where(~F.col("is_builtin")).join(wanted.select("type_id"), "type_id", "left_semi").select("type_id")
    return types.join(gone, "type_id", "left_anti")
