"""Queries of lists, lookups, jobs and configurations, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.operators import costs, lifecycle, listings, rules, segments, store
from pagegraph.operators.evaluation import report
from pagegraph.operators.inference import usage
from pagegraph.plans._registry import registry
from pagegraph.plans.check_queries import _PRICED
from pagegraph.plans.shapes import shape
from pagegraph.session import table
from pagegraph.sources import files

QUERIES, ORACLE_SQL, query = registry()

_STATES = ("queued", "processing", "completed", "failed", "cancelled")


def _state(key: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in _STATES]), F.pmod(key, F.lit(len(_STATES))).cast("int"))


_STATE = "['queued', 'processing', 'completed', 'failed', 'cancelled'][o_orderkey % 5 + 1]"


def _jobs(spark, sf_dir) -> DataFrame:
    """Orders as jobs, with three steps each."""
    k = F.col("o_orderkey")
    step = lambda name, status: F.struct(F.lit(name).alias("key"), status.alias("status"), F.lit(None).cast("string").alias("detail"))
    steps = F.array(step("upload", F.lit("completed")), step("extract", F.when(k % 5 == 1, "running").when(k % 5 == 0, "pending").otherwise("completed")), step("summary", F.when(k % 7 == 1, "running").otherwise("pending")))
    return table(spark, sf_dir, "orders").select(k.alias("job_id"), _state(k).alias("status"), F.lit(None).cast("string").alias("error"), steps.alias("steps"), (k % 4 != 0).alias("has_source"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("updated_at"), F.col("o_totalprice").alias("cost_usd"), (k % 3).alias("calls"))


def _told(jobs: DataFrame) -> DataFrame:
    """Jobs with their steps as text."""
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["key"], s["status"], s["detail"])), "|")
    return jobs.select("job_id", "status", "error", steps.alias("steps"))


_JOBS = f"""j AS (SELECT o_orderkey AS job_id, {_STATE} AS status, NULL::VARCHAR AS error, CASE o_orderkey % 5 WHEN 1 THEN 'running' WHEN 0 THEN 'pending' ELSE 'completed' END AS s2, CASE WHEN o_orderkey % 7 = 1 THEN 'running' ELSE 'pending' END AS s3, o_orderkey % 4 <> 0 AS has_source FROM orders)"""


def _steps_sql(change: str, of: str = "x") -> str:
    """The steps as text, with {change} for the state of one that runs."""
    each = [f"'{name}:' || CASE WHEN {of} AND {s} = 'running' THEN {change} ELSE {s} END" for name, s in (("extract", "s2"), ("summary", "s3"))]
    return "'upload:completed|' || " + " || '|' || ".join(each)


# Lists


@query(f"SELECT o_orderkey AS job_id, {_STATE} AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def jobs_listed(spark, sf_dir):
    return listings.ordered_jobs(listings.job_summaries(_jobs(spark, sf_dir).withColumnRenamed("steps", "pipeline"))).select("job_id", "status")


@query("SELECT o_orderkey AS job_id, o_totalprice AS cost_usd FROM orders WHERE o_orderkey % 3 > 0 AND o_orderdate >= TIMESTAMP '1995-01-02'")
def jobs_by_cost(spark, sf_dir):
    recent = listings.billed(_jobs(spark, sf_dir).withColumn("created_at", F.col("updated_at")), F.lit("1995-01-02").cast("timestamp"))
    return listings.jobs_by_cost(recent).select("job_id", "cost_usd")


@query("SELECT count(*) FILTER (WHERE o_orderkey % 5 < 2) AS active, count(*) FILTER (WHERE o_orderkey % 5 = 2) AS ready FROM orders")
def job_counts(spark, sf_dir):
    return listings.job_counts(_jobs(spark, sf_dir))


def _configs(spark, sf_dir) -> DataFrame:
    """Nations as configurations."""
    k = F.col("n_nationkey")
    name = F.when(k == 3, F.lit("ALGERIA (copy)")).when(k == 4, F.lit("ALGERIA (copy) 3")).otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("c"), k.cast("string")).alias("config_id"), name.alias("name"), (k % 4).cast("bigint").alias("version"), (k == 7).alias("is_default"), (k % 9 == 0).alias("is_seeded"), (100 - k).alias("created_at"))


_CONFIGS = "c AS (SELECT 'c' || n_nationkey AS config_id, CASE n_nationkey WHEN 3 THEN 'ALGERIA (copy)' WHEN 4 THEN 'ALGERIA (copy) 3' ELSE n_name END AS name, CAST(n_nationkey % 4 AS BIGINT) AS version, n_nationkey = 7 AS is_default, n_nationkey % 9 = 0 AS is_seeded, 100 - n_nationkey AS created_at, n_nationkey AS k FROM nation)"


def _rules(spark, sf_dir) -> DataFrame:
    """Parts as rules of configurations."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("c"), (k % 20).cast("string")).alias("config_id"), F.concat(F.lit("r"), k.cast("string")).alias("rule_id"), F.col("p_brand").alias("document_type"), F.when(k % 2 == 0, "extract").otherwise("skip").alias("action"), F.floor(k / 20).cast("int").alias("sort_order"))


_RULES = "r AS (SELECT 'c' || (p_partkey % 20) AS config_id, 'r' || p_partkey AS rule_id, p_brand AS document_type, CASE WHEN p_partkey % 2 = 0 THEN 'extract' ELSE 'skip' END AS action, CAST(p_partkey // 20 AS INTEGER) AS sort_order FROM part)"


@query(f"WITH {_CONFIGS} SELECT config_id, CAST(row_number() OVER (ORDER BY is_default DESC, name, config_id) AS INTEGER) AS place, is_default AS chosen FROM c")
def configs_listed(spark, sf_dir):
    c = _configs(spark, sf_dir)
    order = Window.orderBy(F.col("is_default").desc(), "name", "config_id")
    chosen = listings.default_config(c).select("config_id", F.lit(True).alias("chosen"))
    return listings.ordered_configs(c).withColumn("place", F.row_number().over(order)).join(chosen, "config_id", "left").select("config_id", "place", F.coalesce("chosen", F.lit(False)).alias("chosen"))


_TYPES = "t AS (SELECT p_brand AS name, false AS is_builtin FROM part GROUP BY 1 UNION ALL SELECT unnest(['Imaging', 'clinical', 'administrative']), true)"


def _types(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit(False).alias("is_builtin")).distinct()
    return own.unionByName(spark.createDataFrame([("Imaging", True), ("clinical", True), ("administrative", True)], "name string, is_builtin boolean"))


@query(f"WITH {_TYPES} SELECT name, CAST(row_number() OVER (ORDER BY is_builtin DESC, CASE lower(name) WHEN 'clinical' THEN 1 WHEN 'imaging' THEN 2 WHEN 'administrative' THEN 5 ELSE 9 END, lower(name)) AS INTEGER) AS rank FROM t")
def types_listed(spark, sf_dir):
    return listings.ordered_types(_types(spark, sf_dir)).select("name", "rank")


@query("""WITH u AS (SELECT DISTINCT trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' || p_brand ELSE upper(p_brand) END) AS n, p_partkey FROM part), f AS (SELECT lower(n) AS k, arg_min(n, p_partkey) AS n FROM u GROUP BY 1)
SELECT coalesce(f.n, l.n) AS name FROM (VALUES ('clinical'), ('Brand#11'), ('referral form')) l(n) FULL JOIN f ON lower(l.n) = f.k""")
def type_suggestions(spark, sf_dir):
    k = F.col("p_partkey")
    used = table(spark, sf_dir, "part").select(k.alias("rule_ord"), F.when(k % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise(F.upper("p_brand")).alias("document_type"))
    return listings.suggested_types(["clinical", "Brand#11"], ["BRAND#11", "referral form"], used).select("name")


@query(f"WITH {_TYPES}, d AS (SELECT name, CASE WHEN is_builtin THEN 'The parser''s own BRAND' END AS description FROM t) SELECT name FROM d WHERE contains(lower(name), 'brand#1') OR contains(lower(coalesce(description, '')), 'brand#1') UNION ALL SELECT name FROM d WHERE is_null_test".replace("is_null_test", "description IS NOT NULL AND contains(lower(description), 'own')"))
def types_found(spark, sf_dir):
    t = _types(spark, sf_dir).withColumn("description", F.when(F.col("is_builtin"), "The parser's own BRAND"))
    return listings.find_types(t, " Brand#1").select("name").unionByName(listings.find_types(t, "OWN").select("name"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem) WHERE n <= 320""")
def evidence_limit(spark, sf_dir):
    return listings.first_evidence(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id, text[1:12000] AS whole, text[1:6000] AS layer FROM documents")
def texts_clipped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", listings.clipped(F.col("text")).alias("whole"), listings.clipped(F.col("text"), listings.TEXT_LAYER).alias("layer"))


@query("""SELECT o_custkey AS folder, 'f' || o_orderkey AS name, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END DESC NULLS LAST, 'f' || o_orderkey) AS INTEGER) AS rank FROM orders""")
def drive_listing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return listings.drive_listing(o.select(F.col("o_custkey").alias("folder"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate")).alias("modified"))).select("folder", "name", "rank")


@query("SELECT file_id, doc_pos, CAST(row_number() OVER (PARTITION BY file_id ORDER BY n_evidence, doc_pos) AS INTEGER) AS place FROM {d} d WHERE include")
def documents_in_order(spark, sf_dir):
    d = listings.included(shape(spark, sf_dir, "documents_of_orders"))
    return listings.in_document_order(d.withColumn("page_start", F.col("n_evidence"))).select("file_id", "doc_pos", "place")


@query("""SELECT c.c_custkey AS file_id, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name || '.PDF' END AS name, CASE WHEN c_custkey % 6 = 0 THEN 'application/octet-stream' ELSE 'application/pdf' END AS content_type, CAST(CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey END AS BIGINT) AS size_bytes, j.o_orderkey AS linked_job_id, j.st AS linked_status
FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey, """ + _STATE + """ AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) j ON j.o_custkey = c.c_custkey AND n = 1 WHERE c_custkey % 4 <> 0""")
def file_rows(spark, sf_dir):
    k = F.col("c_custkey")
    every = table(spark, sf_dir, "customer").select(k.alias("file_id"), F.when(k % 6 != 0, F.concat("c_name", F.lit(".PDF"))).alias("name"), F.lit(None).cast("string").alias("content_type"), F.when(k % 5 != 0, k).alias("size_bytes"), (k % 4 != 0).alias("can_extract"))
    newest = store.latest(_jobs(spark, sf_dir).withColumn("file_id", F.col("owner")), ["file_id"], F.col("updated_at").desc(), F.col("job_id").desc())
    return listings.file_rows(listings.extractable(every), newest)


@query("""SELECT k AS job_id, o_orderkey IS NOT NULL AS found, o_custkey AS owner FROM (SELECT UNNEST(range(0, 400)) AS k) w LEFT JOIN orders ON o_orderkey = k""")
def job_lookup(spark, sf_dir):
    got = listings.lookup(_jobs(spark, sf_dir).select("job_id", "owner"), "job_id", spark.range(0, 400).select(F.col("id").alias("job_id")))
    return got.select("job_id", "found", F.col("row.owner").alias("owner"))


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 = 0 THEN 'flat' ELSE 'inner' END AS title, CASE WHEN o_orderkey % 4 = 0 THEN 'vault' WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'payload' END AS source_file_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_orderkey END AS BIGINT) AS pages, o_orderkey % 3 <> 0 AS readable FROM orders""")
def decoded_jobs(spark, sf_dir):
    k = F.col("o_orderkey")
    good = F.concat(F.lit('{"title": "inner", "source_file_id": "payload", "pages": '), k.cast("string"), F.lit("}"))
    records = table(spark, sf_dir, "orders").select(k.alias("job_id"), F.when(k % 3 == 0, F.lit("gAAAA broken")).otherwise(good).alias("payload"), F.lit("flat").alias("title"), F.when(k % 4 == 0, "vault").alias("source_file_id"), F.col("o_custkey").cast("bigint").alias("pages"))
    return listings.decoded_jobs(records, {"title": "string", "source_file_id": "string", "pages": "bigint"})


@query("SELECT o_custkey AS job_id, count(DISTINCT o_orderstatus) AS patient_count, count(*) FILTER (WHERE o_orderkey % 6 <> 0) AS document_count FROM orders GROUP BY 1")
def job_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return listings.job_totals(o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("patient"), (F.col("o_orderkey") % 6 == 0).alias("is_placeholder")))


@query("SELECT file_id, count(DISTINCT page_number) AS pages FROM {e} e GROUP BY 1")
def pages_seen(spark, sf_dir):
    return listings.pages_seen(shape(spark, sf_dir, "entries"))


@query("""WITH e AS (SELECT *, CAST(sha256(CAST(file_id * 1000 + entry_seq AS STRING)) AS VARCHAR) AS h FROM {e} e), a AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY h) AS answer_seq FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY file_id, page_number ORDER BY answer_seq) = 1 AS fresh FROM a) SELECT file_id, entry_seq, CAST(sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY answer_seq) AS BIGINT) AS done FROM f""")
def page_progress(spark, sf_dir):
    h = F.sha2((F.col("file_id") * 1000 + F.col("entry_seq")).cast("string"), 256)
    answers = shape(spark, sf_dir, "entries").withColumn("answer_seq", F.row_number().over(Window.partitionBy("file_id").orderBy(h)))
    return listings.page_progress(answers).select("file_id", "entry_seq", "done")


@query("""SELECT o_orderkey AS job_id, n.name, CASE WHEN (o_orderkey + length(n.name)) % 3 = 0 THEN 'jobs/' || o_orderkey || '.json' WHEN n.name = 'source_pdf' AND o_custkey % 5 <> 0 THEN 'vault/' || o_custkey || '.pdf' END AS object_key,
 CASE WHEN (o_orderkey + length(n.name)) % 3 = 0 THEN 'application/json' WHEN n.name = 'source_pdf' AND o_custkey % 5 <> 0 THEN 'application/pdf' ELSE 'application/octet-stream' END AS content_type, (o_orderkey + length(n.name)) % 3 = 0 OR (n.name = 'source_pdf' AND o_custkey % 5 <> 0) AS found
FROM orders, (VALUES ('source_pdf'), ('summary_doc')) n(name)""")
def stored_artifacts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    wanted = o.select(F.col("o_orderkey").alias("job_id"), F.explode(F.array(F.lit("source_pdf"), F.lit("summary_doc"))).alias("name"))
    kept = wanted.where((F.col("job_id") + F.length("name")) % 3 == 0).withColumn("object_key", F.concat(F.lit("jobs/"), F.col("job_id").cast("string"), F.lit(".json")))
    vault = o.select(F.col("o_custkey").alias("file_id")).distinct().where("file_id % 5 <> 0").withColumn("object_key", F.concat(F.lit("vault/"), F.col("file_id").cast("string"), F.lit(".pdf")))
    return listings.stored_artifacts(wanted, kept, o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("source_file_id")), vault)


# Jobs that change


@query(f"""WITH {_JOBS}, x AS (SELECT *, job_id % 6 = 1 AS x FROM j) SELECT job_id, CASE WHEN x THEN 'failed' ELSE status END AS status,
 CASE WHEN x THEN CASE WHEN job_id % 4 = 0 OR job_id % 12 = 7 THEN 'TimeoutError' ELSE 'bad key [redacted] for ' || job_id END END AS error, {_steps_sql("'failed:' || CASE WHEN job_id % 12 = 7 THEN 'TimeoutError' ELSE 'bad key [redacted] for ' || job_id END")} AS steps FROM x""")
def jobs_failed(spark, sf_dir):
    k = F.col("job_id")
    failures = _jobs(spark, sf_dir).where(k % 6 == 1).select("job_id", F.when(k % 12 == 7, "").otherwise(F.concat(F.lit("bad key sk-proj-0123456789abcdefgh for "), k.cast("string"))).alias("message"), F.lit("TimeoutError").alias("kind"))
    return _told(lifecycle.failed(_jobs(spark, sf_dir), failures))


@query(f"""WITH {_JOBS}, x AS (SELECT *, job_id % 2 = 1 AND status IN ('queued', 'processing') AS x FROM j) SELECT job_id, CASE WHEN x THEN 'cancelled' ELSE status END AS status, CASE WHEN x THEN 'Job cancelled by user.' END AS error, {_steps_sql("'failed:Cancelled by user.'")} AS steps FROM x""")
def jobs_cancelled(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return _told(lifecycle.cancelled(jobs, jobs.where("job_id % 2 = 1").select("job_id")))


@query(f"""WITH {_JOBS}, x AS (SELECT *, status = 'failed' AND has_source AS x FROM j) SELECT job_id, CASE WHEN x THEN 'queued' ELSE status END AS status, error,
 CASE WHEN x THEN 'upload:completed:Source document encrypted and stored.|extract:pending:Waiting for retry.|summary:pending:Waiting for retry.' ELSE 'upload:completed|extract:' || s2 || '|summary:' || s3 END AS steps FROM x""")
def jobs_retried(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return _told(lifecycle.retried(jobs, jobs.where("status = 'failed'").select("job_id")))


@query(f"""WITH {_JOBS}, x AS (SELECT *, status IN ('queued', 'processing') AS x FROM j) SELECT job_id, CASE WHEN x THEN 'queued' ELSE status END AS status, error, {_steps_sql("'pending:Queued to resume after server restart.'")} AS steps FROM x""")
def jobs_recovered(spark, sf_dir):
    return _told(lifecycle.recovered_jobs(_jobs(spark, sf_dir)))


@query(f"""WITH {_JOBS} SELECT job_id, status, error, 'upload:completed|extract:' || CASE WHEN job_id % 3 = 0 THEN 'completed:2 of 2' ELSE s2 END || '|summary:' || s3 AS steps FROM j""")
def steps_changed(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    changes = jobs.where("job_id % 3 = 0").select("job_id", F.lit("extract").alias("key"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    changes = changes.select("job_id", "key", "seq", F.when(F.col("seq") == 2, "completed").otherwise("running").alias("status"), F.concat(F.col("seq").cast("string"), F.lit(" of 2")).alias("detail"))
    return _told(lifecycle.step_changed(jobs, changes))


@query(f"""WITH {_PRICED}, t AS (SELECT stage, provider, c.model, count(*) AS calls, sum(input_tokens) AS i0, sum(output_tokens) AS o0, sum(cached_tokens) AS c0, any_value(i) AS i, any_value(o) AS o, any_value(b.c) AS p FROM calls c LEFT JOIN b ON c.model = b.model GROUP BY ALL),
u AS (SELECT *, greatest(0, coalesce((i0 - c0) * CAST(i * 1000 AS BIGINT) + o0 * CAST(o * 1000 AS BIGINT) + c0 * CAST(p * 1000 AS BIGINT), 0)) AS nano FROM t),
ps AS (SELECT stage, sum(calls) AS calls, CAST((CAST(sum(nano) AS BIGINT) + 500) // 1000 AS BIGINT) AS micro FROM u GROUP BY 1), pm AS (SELECT provider, model, sum(calls) AS calls, CAST((CAST(sum(nano) AS BIGINT) + 500) // 1000 AS BIGINT) AS micro FROM u GROUP BY 1, 2)
SELECT CAST(sum(calls) AS BIGINT) AS calls, CAST((CAST(sum(nano) AS BIGINT) + 500) // 1000 AS BIGINT) AS micro, (SELECT string_agg(stage || ':' || calls || ':' || micro, '|' ORDER BY stage) FROM ps) AS stages, (SELECT string_agg(provider || ':' || model || ':' || calls || ':' || micro, '|' ORDER BY provider, model) FROM pm) AS models FROM u""")
def cost_breakdown(spark, sf_dir):
    got = lifecycle.cost_breakdown(costs.cost_summary(costs.with_prices(shape(spark, sf_dir, "calls"), costs.price_table(spark))))

    def micro(usd: Column) -> Column:
        return F.round(usd * 1_000_000).cast("bigint")

    stages = F.array_join(F.transform("by_stage", lambda s: F.concat_ws(":", s["stage"], s["calls"].cast("string"), micro(s["usd"]).cast("string"))), "|")
    models = F.array_join(F.transform("by_model", lambda s: F.concat_ws(":", s["provider"], s["model"], s["calls"].cast("string"), micro(s["usd"]).cast("string"))), "|")
    return got.select("calls", micro(F.col("usd")).alias("micro"), stages.alias("stages"), models.alias("models"))


@query("""WITH c AS (SELECT file_id AS job_id, CASE stage WHEN 'click' THEN 'extract' WHEN 'view' THEN 'summary' END AS key, sum(input_tokens) AS i, sum(output_tokens) AS o FROM {c} c GROUP BY 1, 2)
SELECT s.job_id, s.key, CAST(coalesce(i, 0) AS BIGINT) AS input_tokens, CAST(coalesce(o, 0) AS BIGINT) AS output_tokens FROM (SELECT DISTINCT file_id AS job_id, k.key FROM {c} c, (VALUES ('upload'), ('extract'), ('summary')) k(key)) s LEFT JOIN c ON c.job_id = s.job_id AND c.key = s.key""")
def step_costs(spark, sf_dir):
    calls = shape(spark, sf_dir, "calls").withColumn("stage", F.when(F.col("stage") == "click", "parse").when(F.col("stage") == "view", "summarize").otherwise(F.col("stage")))
    by_stage = calls.groupBy(F.col("file_id").alias("job_id"), "stage").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.lit(0.0).alias("usd"))
    steps = calls.select(F.col("file_id").alias("job_id")).distinct().select("job_id", F.explode(F.array(F.lit("upload"), F.lit("extract"), F.lit("summary"))).alias("key"))
    return lifecycle.step_costs(by_stage, steps).select("job_id", "key", F.col("input_tokens").cast("bigint").alias("input_tokens"), F.col("output_tokens").cast("bigint").alias("output_tokens"))


# Configurations and types


@query(f"""WITH {_CONFIGS}, {_RULES}, w AS (SELECT k AS request_id, CASE WHEN k % 3 = 0 THEN 'c7' WHEN k % 3 = 1 THEN 'c' || k ELSE NULL END AS config_id FROM (SELECT unnest(range(0, 40)) AS k)),
l AS (SELECT config_id, string_agg(sort_order || ':' || rule_id || ':' || action, '|' ORDER BY sort_order, rule_id) AS rules FROM r GROUP BY 1)
SELECT w.request_id, c.config_id, c.name, c.version, coalesce(l.rules, '') AS rules FROM (SELECT request_id, CASE WHEN request_id % 3 = 2 THEN 'c7' ELSE config_id END AS config_id FROM w) w JOIN c ON c.config_id = w.config_id LEFT JOIN l ON l.config_id = c.config_id""")
def config_snapshots(spark, sf_dir):
    k = F.col("id")
    wanted = spark.range(0, 40).select(k.alias("request_id"), F.when(k % 3 == 0, "c7").when(k % 3 == 1, F.concat(F.lit("c"), k.cast("string"))).alias("config_id"))
    got = lifecycle.snapshot(_configs(spark, sf_dir), _rules(spark, sf_dir), wanted)
    return got.select("request_id", "config_id", "name", "version", F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["sort_order"].cast("string"), r["rule_id"], r["action"])), "|").alias("rules"))


@query(f"""WITH {_CONFIGS} SELECT name, version, is_default FROM c UNION ALL SELECT CASE WHEN name = 'ALGERIA' THEN 'ALGERIA (copy) 2' ELSE name || ' (copy)' END, 1, false FROM c WHERE k % 6 = 0 OR k = 3""")
def config_copies(spark, sf_dir):
    c = _configs(spark, sf_dir)
    chosen = c.where(F.col("config_id").isin("c0", "c6", "c12", "c18", "c24", "c3"))
    return lifecycle.with_copies(c, chosen.select("config_id")).select("name", "version", "is_default")


@query(f"""WITH {_CONFIGS}, {_RULES}, n AS (SELECT 'c' || (k % 3) AS config_id, 'n' || k AS rule_id, 'type ' || k AS document_type, 'skip' AS action, CAST(row_number() OVER (PARTITION BY k % 3 ORDER BY -k) - 1 AS INTEGER) AS sort_order FROM (SELECT unnest(range(0, 12)) AS k)),
a AS (SELECT * FROM r WHERE config_id NOT IN ('c0', 'c1', 'c2') UNION ALL SELECT * FROM n) SELECT a.config_id, a.rule_id, a.sort_order, CAST(c.version + CASE WHEN c.k < 3 THEN 1 ELSE 0 END AS BIGINT) AS version FROM a JOIN c ON c.config_id = a.config_id""")
def rules_replaced(spark, sf_dir):
    k = F.col("id")
    changed = spark.range(0, 12).select(F.concat(F.lit("c"), (k % 3).cast("string")).alias("config_id"), F.concat(F.lit("n"), k.cast("string")).alias("rule_id"), F.concat(F.lit("type "), k.cast("string")).alias("document_type"), F.lit("skip").alias("action"), (-k).alias("given"))
    configs, listed = lifecycle.replaced_rules(_configs(spark, sf_dir), _rules(spark, sf_dir), changed)
    return listed.join(configs.select("config_id", F.col("version").cast("bigint").alias("version")), "config_id").select("config_id", "rule_id", "sort_order", "version")


@query(f"""WITH {_TYPES}, w AS (SELECT p_partkey AS type_id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE 'new ' || (p_partkey % 40) END AS name FROM part)
SELECT type_id, name, lower(name) NOT IN (SELECT lower(name) FROM t) AND row_number() OVER (PARTITION BY lower(name) ORDER BY type_id) = 1 AS accepted FROM w""")
def types_created(spark, sf_dir):
    k = F.col("p_partkey")
    wanted = table(spark, sf_dir, "part").select(k.alias("type_id"), F.when(k % 3 == 0, F.upper("p_brand")).otherwise(F.concat(F.lit("new "), (k % 40).cast("string"))).alias("name"))
    return lifecycle.created_types(_types(spark, sf_dir), wanted)


@query(f"WITH {_TYPES} SELECT name FROM t WHERE is_builtin OR NOT starts_with(name, 'Brand#2')")
def types_removed(spark, sf_dir):
    t = _types(spark, sf_dir).withColumn("type_id", F.col("name"))
    return lifecycle.without_types(t, t.where(F.col("name").startswith("Brand#2") | F.col("is_builtin")).select("type_id")).select("name")


@query(f"WITH {_CONFIGS}, {_RULES} SELECT c.config_id, coalesce((SELECT string_agg(rule_id, '|' ORDER BY sort_order, rule_id) FROM r WHERE r.config_id = c.config_id), '') AS rules FROM c")
def configs_with_rules(spark, sf_dir):
    got = rules.config_with_rules(_configs(spark, sf_dir), _rules(spark, sf_dir))
    return got.select("config_id", F.array_join(F.transform("rules", lambda r: r["rule_id"]), "|").alias("rules"))


@query(f"""WITH {_CONFIGS} SELECT 'set' AS change, config_id, config_id = 'c9' AS is_default FROM c UNION ALL SELECT 'deleted', config_id, config_id = 'c18' FROM c WHERE k <> 7 UNION ALL SELECT 'last', config_id, is_default FROM c WHERE k = 7""")
def default_configs(spark, sf_dir):
    """Setting a default, deleting it, and deleting the last one of all."""
    c = _configs(spark, sf_dir)
    parts = (("set", rules.set_default(c, "c9")), ("deleted", rules.delete_config(c, "c7")), ("last", rules.delete_config(c.where("config_id = 'c7'"), "c7")))
    each = [df.select(F.lit(name).alias("change"), "config_id", "is_default") for name, df in parts]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("""WITH k AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_size < 25) SELECT name FROM k UNION ALL SELECT DISTINCT ON (lower(p_type)) lower(p_type) FROM part WHERE lower(p_type) NOT IN (SELECT lower(name) FROM k)
UNION ALL SELECT DISTINCT lower(p_brand) FROM part WHERE lower(p_brand) NOT IN (SELECT lower(name) FROM k)""")
def types_registered(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    known = part.where("p_size < 25").select(F.col("p_brand").alias("name")).distinct()
    wanted = part.select(F.explode(F.array(F.concat(F.lit(" "), F.lower("p_type")), F.lower("p_brand"), F.lit(" "))).alias("name"))
    return rules.insert_missing(known, wanted, "name")


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'blank_type' END, CASE WHEN p_partkey % 5 = 1 THEN 'long_type' END, CASE WHEN p_size NOT BETWEEN 10 AND 2000 THEN 'max_words' END, CASE WHEN count(*) OVER (PARTITION BY p_brand) > 50 THEN 'too_many' END], lambda x: x IS NOT NULL), '|') AS faults FROM part")
def rule_faults(spark, sf_dir):
    k = F.col("p_partkey")
    r = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("config_id"), F.when(k % 5 == 0, " ").when(k % 5 == 1, F.repeat(F.lit("x"), F.lit(121))).otherwise("type").alias("document_type"), F.col("p_size").alias("max_words"))
    return rules.checked_rules(r).select("p_partkey", F.array_join("faults", "|").alias("faults"))


@query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 2 = 0 AND p_size > 5 THEN p_size WHEN p_partkey % 3 = 0 THEN 300 ELSE 90 END AS INTEGER) AS ceiling, CASE p_partkey % 4 WHEN 0 THEN 'full_data' WHEN 1 THEN CASE WHEN p_partkey % 5 = 0 THEN 'skip' ELSE 'extract' END WHEN 2 THEN 'extract' ELSE 'extract' END AS action FROM part""")
def rule_effects(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    ceiling = rules.word_ceiling(k % 2 == 0, F.when(F.col("p_size") > 5, F.col("p_size")), F.when(k % 3 == 0, 300), F.lit(90))
    return p.select("p_partkey", ceiling.alias("ceiling"), rules.document_action(F.when(k % 4 == 0, "full_data").when(k % 4 == 2, "extract"), k % 4 == 3, F.when(k % 5 == 0, "pathology").otherwise("clinical")).alias("action"))


# What else is kept


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 2 <> 0""")
def legacy_import(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("bigint").alias("o_custkey"))
    legacy = o.withColumn("o_custkey", F.lit(-1).cast("bigint"))
    return files.import_new(o.where("o_orderkey % 2 = 0"), legacy.unionByName(legacy), "o_orderkey")


@query("""WITH h AS (SELECT file_id, doc_pos, iso, bucket, author, iso[1:7] AS month, row_number() OVER (PARTITION BY file_id, iso[1:7] ORDER BY iso DESC, doc_pos DESC) AS n FROM {d} d WHERE doc_pos % 2 = 0),
t AS (SELECT file_id, month, doc_pos, iso, 0 AS new FROM h WHERE n = 1), c AS (SELECT file_id, iso[1:7] AS month, doc_pos, iso, 1 AS new FROM {d} d WHERE doc_pos % 2 <> 0 AND doc_pos % 3 = 0),
o AS (SELECT file_id, month, max(doc_pos) AS doc_pos, iso, new FROM c GROUP BY file_id, month, iso, new UNION ALL SELECT file_id, month, doc_pos, iso, new FROM t),
w AS (SELECT *, row_number() OVER (PARTITION BY file_id, month ORDER BY iso DESC, new DESC, doc_pos DESC) AS n FROM o) SELECT file_id, month, doc_pos FROM w WHERE n = 1""")
def table_upsert(spark, sf_dir):
    d = shape(spark, sf_dir, "documents_of_orders").select("file_id", F.substring("iso", 1, 7).alias("month"), "doc_pos", "iso")
    had = store.latest(d.where("doc_pos % 2 = 0"), ["file_id", "month"], F.col("iso").desc(), F.col("doc_pos").desc())
    changes = store.latest(d.where("doc_pos % 2 <> 0 and doc_pos % 3 = 0"), ["file_id", "month", "iso"], F.col("doc_pos").desc())
    return store.upsert(had, changes, ["file_id", "month"], "iso").select("file_id", "month", "doc_pos")


@query("""WITH c AS (SELECT o_custkey AS file_id, count(*) AS checks, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS findings, count(*) FILTER (WHERE o_orderkey % 8 = 0) AS critical FROM orders GROUP BY 1)
SELECT file_id, critical, findings - critical AS error, CAST(0 AS BIGINT) AS warning, greatest(0.0, CAST(checks - findings AS DOUBLE) / checks) AS score FROM c""")
def evaluation_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    findings = o.where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("file_id"), F.when(F.col("o_orderkey") % 8 == 0, "critical").otherwise("error").alias("severity"))
    return report(findings, o.groupBy(F.col("o_custkey").alias("file_id")).agg(F.count("*").alias("checks"))).select("file_id", "critical", "error", "warning", "score")


@query("""SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN event_id WHEN 1 THEN event_id ELSE 0 END AS BIGINT) AS input_tokens, CAST(CASE event_id % 3 WHEN 0 THEN 7 WHEN 1 THEN 8 ELSE 0 END AS BIGINT) AS output_tokens, CAST(CASE event_id % 3 WHEN 1 THEN 5 ELSE 0 END AS BIGINT) AS cached_tokens FROM events""")
def usage_counts_of_answers(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 3 == 0, F.format_string('{"usage": {"prompt_tokens": %d, "completion_tokens": 7}}', k)).when(k % 3 == 1, F.format_string('{"usage": {"input_tokens": %d, "output_tokens": 8, "input_tokens_details": {"cached_tokens": 5}}}', k)).otherwise("{}")
    return table(spark, sf_dir, "events").select("event_id", *[v.alias(c) for c, v in usage(raw).items()])


@query(r"""WITH s AS (SELECT doc_id, [regexp_replace(lower(source), '[^a-z0-9]', '', 'g'), lang, 'b'] AS x FROM documents) SELECT doc_id, array_to_string(list_sort(x), '|') AS signature FROM s""")
def evidence_signatures(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", segments.evidence_signature(F.array(F.concat(F.lit(" "), F.upper("source"), F.lit("-")), F.concat("lang", F.lit(".")), F.lit("B"))).alias("signature"))
