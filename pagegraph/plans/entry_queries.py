"""Queries of entries, runs, segments and bundles, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.functions.text import normalize_key
from pagegraph.operators import entries as E
from pagegraph.operators import evaluation, headers, healing, linkage, segments
from pagegraph.plans.shapes import shape, shape_sql
from pagegraph.session import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL; {e}, {d}: the entries, the documents."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("{e}", f"({shape_sql('entries')})").replace("{d}", f"({shape_sql('documents_of_orders')})")
        return f

    return keep


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape(spark, sf_dir, "entries")


@query("""SELECT file_id, entry_seq, coalesce(marker_index > 0 AND marker_index <= marker_total AND marker_total > 1, false) AS usable,
 coalesce(marker_index = 1 AND marker_total > 1, false) AS is_first, coalesce(marker_index > 1 AND marker_index <= marker_total, false) AS is_continuation FROM {e} e""")
def marker_predicates(spark, sf_dir):
    return E.with_marker_flags(_entries(spark, sf_dir)).select("file_id", "entry_seq", "usable", "is_first", "is_continuation")


@query("""WITH f AS (SELECT file_id, max(page_number) + 1 AS n FROM {e} e GROUP BY file_id),
p AS (SELECT file_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS page_number FROM f), e AS (SELECT * FROM {e} e)
SELECT p.file_id, p.page_number, e.entry_seq, coalesce(e.kind, 'empty') AS kind, coalesce(e.include, false) AS include, e.entry_seq IS NULL AS missing
FROM p LEFT JOIN e ON p.file_id = e.file_id AND p.page_number = e.page_number""")
def entries_missing_page_fill(spark, sf_dir):
    e = _entries(spark, sf_dir)
    counts = e.groupBy("file_id").agg((F.max("page_number") + 1).alias("page_count"))
    return E.fill_missing_pages(e, counts).select("file_id", "page_number", "entry_seq", "kind", "include", "missing")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS ordinal, turn, role, text FROM conversations")
def nested_expand(spark, sf_dir):
    packed = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return E.expand_nested(packed, "turns").select("conv_id", "ordinal", "turns.turn", "turns.role", "turns.text")


_RUNS = """WITH e AS (SELECT *, marker_index > 0 AND marker_index <= marker_total AND marker_total > 1 AS u FROM {e} e),
l AS (SELECT *, coalesce(u AND lag(u) OVER w AND lag(marker_total) OVER w = marker_total AND lag(marker_index) OVER w + 1 = marker_index, false) AS linked,
 lead(u AND marker_index = 1) OVER w AS nf, lead(entry_seq) OVER w IS NULL AS fin FROM e WINDOW w AS (PARTITION BY file_id ORDER BY entry_seq)),
i AS (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY entry_seq) AS island FROM l),
g AS (SELECT file_id, island, min(entry_seq) AS s, min(marker_index) AS lo, max_by(marker_index = marker_total OR coalesce(nf, false) OR fin, entry_seq) AS ok FROM i GROUP BY file_id, island),
r AS (SELECT i.*, CASE WHEN i.u AND g.lo = 1 AND g.ok THEN g.s END AS run_start FROM i JOIN g ON i.file_id = g.file_id AND i.island = g.island)"""


@query(_RUNS + " SELECT file_id, entry_seq, run_start FROM r")
def printed_runs(spark, sf_dir):
    return E.printed_runs(_entries(spark, sf_dir)).select("file_id", "entry_seq", "run_start")


_REPAIR = _RUNS + """, a AS (SELECT file_id, run_start, bool_or(include) AS any_in, min_by(kind, entry_seq) FILTER (WHERE kind NOT IN ('admin', 'empty', 'signature_only')) AS content, min_by(title, entry_seq) FILTER (WHERE title IS NOT NULL) AS t FROM r WHERE run_start IS NOT NULL GROUP BY ALL),
x AS (SELECT r.* EXCLUDE (include, kind, title, starts_new, run_start), r.run_start, CASE WHEN a.any_in IS NOT NULL THEN a.any_in ELSE r.include END AS include,
 CASE WHEN a.any_in AND r.kind IN ('admin', 'signature_only') THEN coalesce(a.content, r.kind) ELSE r.kind END AS kind, coalesce(r.title, a.t) AS title,
 CASE WHEN a.any_in IS NOT NULL THEN r.entry_seq = r.run_start ELSE r.starts_new END AS starts_new
 FROM r LEFT JOIN a ON r.file_id = a.file_id AND r.run_start = a.run_start)"""


@query(_REPAIR + " SELECT file_id, entry_seq, include, kind, title, starts_new FROM x")
def printed_run_repair(spark, sf_dir):
    return E.repair_printed_runs(_entries(spark, sf_dir)).select("file_id", "entry_seq", "include", "kind", "title", "starts_new")


@query("""SELECT file_id, entry_seq,
 CASE WHEN o THEN patient_name ELSE (last_value(CASE WHEN o THEN {'n': patient_name, 'd': patient_dob, 'i': patient_identifier} END IGNORE NULLS) OVER w).n END AS patient_name,
 CASE WHEN o THEN patient_dob ELSE (last_value(CASE WHEN o THEN {'n': patient_name, 'd': patient_dob, 'i': patient_identifier} END IGNORE NULLS) OVER w).d END AS patient_dob,
 coalesce(patient_identifier, CASE WHEN NOT o THEN (last_value(CASE WHEN o THEN {'n': patient_name, 'd': patient_dob, 'i': patient_identifier} END IGNORE NULLS) OVER w).i END) AS patient_identifier
FROM (SELECT *, patient_name IS NOT NULL OR patient_dob IS NOT NULL AS o FROM {e} e) WINDOW w AS (PARTITION BY file_id ORDER BY entry_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def patient_locf(spark, sf_dir):
    return E.carry_patient(_entries(spark, sf_dir)).select("file_id", "entry_seq", "patient_name", "patient_dob", "patient_identifier")


@query("""WITH l AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
b AS (SELECT *, CASE WHEN seq = 1 OR event_type <> lag(event_type) OVER w OR day <> lag(day) OVER w THEN 1 ELSE 0 END AS b FROM l WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT CAST(user_id AS BIGINT) AS file_id, CAST(seq AS INTEGER) AS entry_seq, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY seq) AS INTEGER) AS segment FROM b""")
def segment_islands(spark, sf_dir):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("file_id"), seq.alias("entry_seq"), "event_type", F.to_date("ts").alias("day"))
    return segments.segment_islands(log, F.col("event_type"), F.col("day")).select("file_id", "entry_seq", "segment")


@query()
def segment_dated_entries(spark, sf_dir):
    return segments.segment_dated(_entries(spark, sf_dir)).select("file_id", "entry_seq", "segment")


_BY_ORDER = "SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY order_key) AS segment FROM {e} e"


def _by_order(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    rank = F.dense_rank().over(Window.partitionBy("file_id").orderBy("order_key"))
    return _entries(spark, sf_dir).withColumn("segment", rank)


@query(f"""WITH s AS ({_BY_ORDER}), """ + """d AS (SELECT file_id, segment, min_by(title, entry_seq) FILTER (WHERE title IS NOT NULL) AS title, min_by(date, entry_seq) FILTER (WHERE date IS NOT NULL) AS date,
 min_by(author, entry_seq) FILTER (WHERE author IS NOT NULL) AS author,
 coalesce(min_by(bucket, entry_seq) FILTER (WHERE bucket <> 'unknown'), min_by(kind, entry_seq) FILTER (WHERE kind IN ('imaging', 'clinical')), 'unknown') AS bucket,
 min_by(page_number, entry_seq) AS page_start, max_by(page_number, entry_seq) AS page_end, count(*) AS n_entries, CAST(sum(n_evidence) AS BIGINT) AS n_evidence,
 bool_or(include) AND max(n_evidence) > 0 AND bool_or(kind NOT IN ('admin', 'empty', 'signature_only')) AS include,
 min_by(coalesce(patient_name, ''), entry_seq) FILTER (WHERE patient_name IS NOT NULL OR patient_dob IS NOT NULL) AS patient_name FROM s GROUP BY ALL)
SELECT file_id, CAST(segment AS INTEGER) AS segment, title, date, author, bucket, page_start, page_end, n_entries, n_evidence, include, nullif(patient_name, '') AS patient_name, 'doc-' || segment || '-' || page_start AS doc_id FROM d""")
def segment_first_nonnull(spark, sf_dir):
    docs = segments.segment_documents(_by_order(spark, sf_dir))
    return docs.select("file_id", "segment", "title", "date", "author", "bucket", "page_start", "page_end", "n_entries", "n_evidence", "include", "patient_name", "doc_id")


_SUBS = f"WITH s AS ({_BY_ORDER}), " + """v AS (SELECT *, CASE WHEN kind NOT IN ('empty', 'signature_only') THEN date END AS d, CASE WHEN kind NOT IN ('empty', 'signature_only') THEN author END AS a FROM s),
b AS (SELECT *, coalesce(d <> last_value(d IGNORE NULLS) OVER w, false) OR coalesce(a <> last_value(a IGNORE NULLS) OVER w, false) AS b FROM v WINDOW w AS (PARTITION BY file_id, segment ORDER BY entry_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(_SUBS + """ SELECT file_id, entry_seq, CAST(sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, segment ORDER BY entry_seq) AS INTEGER) AS sub FROM b""")
def subsections_exact_author(spark, sf_dir):
    return segments.subsections(_by_order(spark, sf_dir)).select("file_id", "entry_seq", "sub")


@query(f"WITH s AS ({_BY_ORDER}), " + """c AS (SELECT *, count(*) OVER (PARTITION BY file_id, segment) AS n, min(entry_seq) OVER (PARTITION BY file_id, segment) AS f FROM s),
o AS (SELECT *, CASE WHEN entry_seq = f AND (segment = 1 OR NOT (n = 1 AND (kind = 'signature_only' OR n_evidence = 0))) THEN 1 ELSE 0 END AS o FROM c)
SELECT file_id, entry_seq, CAST(sum(o) OVER (PARTITION BY file_id ORDER BY entry_seq) - 1 AS INTEGER) AS segment FROM o""")
def fragment_absorb(spark, sf_dir):
    return segments.absorb_fragments(_by_order(spark, sf_dir), "segment").select("file_id", "entry_seq", "segment")


@query("""WITH e AS (SELECT * FROM {e} e), c AS (SELECT DISTINCT file_id, page_number FROM e WHERE bucket <> 'unknown'),
u AS (SELECT DISTINCT file_id, page_number FROM e EXCEPT SELECT * FROM c), g AS (SELECT *, page_number - row_number() OVER (PARTITION BY file_id ORDER BY page_number) AS g FROM u)
SELECT file_id, min(page_number) AS page_start, max(page_number) AS page_end FROM g GROUP BY file_id, g""")
def uncovered_runs(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return E.uncovered_runs(e, e.where("bucket <> 'unknown'").select("file_id", "page_number").distinct())


@query("SELECT file_id, entry_seq, CAST((entry_seq - 1) // 5 AS INTEGER) AS chunk FROM {e} e")
def chunks_of_five(spark, sf_dir):
    return E.chunked(_entries(spark, sf_dir), 5, "entry_seq").select("file_id", "entry_seq", "chunk")


@query("SELECT file_id, entry_seq, CAST(CASE WHEN n_evidence > 0 THEN sum(CASE WHEN n_evidence > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY entry_seq) ELSE 0 END AS BIGINT) AS document_number FROM {e} e")
def document_numbering(spark, sf_dir):
    return E.numbered(_entries(spark, sf_dir), F.col("n_evidence") > 0, "entry_seq").select("file_id", "entry_seq", "document_number")


@query("""WITH c AS (SELECT source AS file_id, doc_id, CAST(coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents)
SELECT file_id, doc_id, before FROM c WHERE before < 12000""")
def context_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), "doc_id", F.length("text").alias("n"))
    return E.within_budget(docs, F.col("n"), 12000, "doc_id").select("file_id", "doc_id", "before")


def _bundles(spark, sf_dir) -> DataFrame:
    """Documents of a customer by order priority, with a span of pages."""
    docs = segments.segment_documents(_by_order(spark, sf_dir))
    return segments.group_by_patient(docs)


@query(f"WITH s AS ({_BY_ORDER}), " + """d AS (SELECT file_id, segment, min_by(page_number, entry_seq) AS ps, max_by(page_number, entry_seq) AS pe,
 min_by({'n': patient_name, 'd': patient_dob}, entry_seq) FILTER (WHERE patient_name IS NOT NULL OR patient_dob IS NOT NULL) AS p FROM s GROUP BY ALL),
k AS (SELECT *, CASE WHEN p.n IS NOT NULL THEN array_to_string(list_sort(string_split(lower(p.n), ' ')), '|') ELSE '' END AS who, coalesce(p.d, '') AS born FROM d),
n AS (SELECT *, CASE WHEN who <> '' AND born <> '' THEN who || '|' || born WHEN born <> '' THEN '|' || born ELSE who END AS key FROM k),
g AS (SELECT file_id, CASE WHEN key = '' THEN '#' || segment ELSE key END AS key, min(segment) AS first_segment, min_by(p.n, segment) FILTER (WHERE p.n IS NOT NULL) AS name, count(*) AS n_documents, min(nullif(ps, 0)) AS page_start, max(pe) AS page_end FROM n GROUP BY 1, 2)
SELECT file_id, key, CAST(first_segment AS INTEGER) AS first_segment, name, n_documents, page_start, page_end, CAST(row_number() OVER (PARTITION BY file_id ORDER BY first_segment) AS INTEGER) AS bundle FROM g""")
def group_by_patient_key(spark, sf_dir):
    return _bundles(spark, sf_dir).select("file_id", "key", "first_segment", "name", "n_documents", "page_start", "page_end", "bundle")


@query()
def bundle_consolidate(spark, sf_dir):
    bundles = _bundles(spark, sf_dir).withColumn("dob", F.nullif(F.regexp_extract("key", r"\|(\d{4}-\d{2}-\d{2})$", 1), F.lit("")))
    return linkage.consolidate_bundles(bundles).select("file_id", "bundle", "patient")


@query("""WITH b AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY doc_pos) AS bundle, sole_page * 10 AS s, sole_page * 10 + n_evidence AS t FROM {d} d WHERE sole_page IS NOT NULL),
p AS (SELECT DISTINCT file_id, CAST(doc_pos % 60 AS INTEGER) AS page_start FROM {d} d),
j AS (SELECT p.file_id, p.page_start, bundle, p.page_start NOT BETWEEN s AND t AS outside, CASE WHEN p.page_start BETWEEN s AND t THEN 0 ELSE least(abs(s - p.page_start), abs(t - p.page_start)) END AS gap FROM p JOIN b ON p.file_id = b.file_id)
SELECT file_id, page_start, CAST(arg_min(bundle, (outside, gap, bundle)) AS INTEGER) AS bundle FROM j GROUP BY ALL""")
def placeholder_attach_nearest(spark, sf_dir):
    from pyspark.sql import Window

    d = shape(spark, sf_dir, "documents_of_orders")
    spans = d.where("sole_page is not null").select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("doc_pos")).alias("bundle"), (F.col("sole_page") * 10).alias("page_start"), (F.col("sole_page") * 10 + F.col("n_evidence")).alias("page_end"))
    return linkage.attach_placeholders(spans, d.select("file_id", F.pmod("doc_pos", F.lit(60)).cast("int").alias("page_start")).distinct())


@query("""WITH c AS (SELECT file_id, author, count(*) AS n, min(entry_seq) AS f FROM {e} e WHERE author IS NOT NULL GROUP BY ALL)
SELECT file_id, arg_max(author, (n, length(author), -f)) AS author FROM c GROUP BY file_id""")
def majority_vote(spark, sf_dir):
    return linkage.majority(_entries(spark, sf_dir), ["file_id"], "author", "entry_seq")


@query("""WITH l AS (SELECT CAST(user_id AS BIGINT) AS file_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
c AS (SELECT file_id, event_type, count(*) AS n, min(seq) AS f FROM l GROUP BY ALL) SELECT file_id, arg_max(event_type, (n, -f)) AS event_type FROM c GROUP BY file_id""")
def mode_first_seen(spark, sf_dir):
    from pyspark.sql import Window

    log = table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("file_id"), "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    return linkage.majority(log, ["file_id"], "event_type", "seq", longest=False)


@query("""WITH e AS (SELECT * FROM {e} e), n AS (SELECT DISTINCT file_id, author AS name FROM e WHERE author IS NOT NULL),
c AS (SELECT file_id, length(name) AS cluster, min(name) AS canonical, list(name) AS members FROM n GROUP BY 1, 2 HAVING count(*) >= 2),
m AS (SELECT file_id, unnest(members) AS name, arg_max(canonical, cluster) OVER (PARTITION BY file_id) AS x, canonical FROM c)
SELECT e.file_id, e.entry_seq, coalesce(a.canonical, e.author) AS author FROM e LEFT JOIN m a ON e.file_id = a.file_id AND e.author = a.name""")
def rename_map(spark, sf_dir):
    e = _entries(spark, sf_dir)
    known = e.where("author is not null").select("file_id", F.col("author").alias("name")).distinct()
    clusters = known.groupBy("file_id", F.length("name").alias("cluster")).agg(F.min("name").alias("canonical"), F.collect_list("name").alias("members"))
    return linkage.renamed(e.select("file_id", "entry_seq", "author"), linkage.rename_map(clusters, known), "author").select("file_id", "entry_seq", "author")


@query("""WITH e AS (SELECT * FROM {e} e), s AS (SELECT file_id, order_key AS key_id, min(page_number) AS ps, max(page_number) AS pe, max(bucket) AS bucket FROM e GROUP BY ALL),
d AS (SELECT file_id, order_key AS entry_id, min(page_number) AS ps, max(page_number) AS pe, min(bucket) AS bucket FROM e WHERE include GROUP BY ALL)
SELECT s.file_id, s.key_id, count(d.file_id) AS n_entries, coalesce(bool_or(s.bucket = d.bucket), false) AS bucket_ok FROM s LEFT JOIN d ON s.file_id = d.file_id AND d.ps <= s.pe AND d.pe >= s.ps GROUP BY ALL""")
def range_overlap_eval(spark, sf_dir):
    e = _entries(spark, sf_dir)
    span = [F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end")]
    key = e.groupBy("file_id", F.col("order_key").alias("key_id")).agg(*span, F.max("bucket").alias("bucket"))
    got = e.where("include").groupBy("file_id", F.col("order_key").alias("entry_id")).agg(*span, F.min("bucket").alias("bucket"))
    return evaluation.overlaps(got, key, ["bucket"])


@query("""WITH e AS (SELECT * FROM {e} e), d AS (SELECT file_id, order_key AS entry_id, min(page_number) AS ps, max(page_number) AS pe FROM e GROUP BY ALL),
o AS (SELECT file_id, entry_id, unnest(range(ps, pe + 1)) AS page FROM d),
t AS (SELECT DISTINCT file_id, k.kind, p.page FROM e, (VALUES ('max_documents'), ('same_document'), ('separate_documents')) k(kind), (VALUES (1), (2), (3)) p(page)),
m AS (SELECT t.file_id, kind, count(DISTINCT entry_id) AS n, count(DISTINCT t.page) AS pages FROM t LEFT JOIN o ON t.file_id = o.file_id AND t.page = o.page GROUP BY ALL)
SELECT file_id, kind AS trap_id, kind, CASE kind WHEN 'max_documents' THEN n > 1 WHEN 'same_document' THEN n > 1 ELSE n < pages END AS failed FROM m""")
def trap_checks(spark, sf_dir):
    e = _entries(spark, sf_dir)
    got = e.groupBy("file_id", F.col("order_key").alias("entry_id")).agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    kinds = F.explode(F.array(F.lit("max_documents"), F.lit("same_document"), F.lit("separate_documents")))
    traps = e.select("file_id").distinct().select("file_id", kinds.alias("kind")).select("file_id", F.col("kind").alias("trap_id"), "kind", F.lit(1).alias("most"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("pages"))
    return evaluation.page_traps(got, traps)


@query("""WITH e AS (SELECT * FROM {e} e), g AS (SELECT file_id, max(page_number) AS n FROM e GROUP BY 1), p AS (SELECT file_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS page FROM g)
SELECT * FROM p EXCEPT SELECT file_id, page_number FROM e WHERE include""")
def page_coverage(spark, sf_dir):
    e = _entries(spark, sf_dir)
    counts = e.groupBy("file_id").agg(F.max("page_number").alias("page_count"))
    got = e.where("include").select("file_id", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"))
    return evaluation.missing_pages(got, counts)


@query()
def heal_documents(spark, sf_dir):
    """Documents of orders, with what they say of themselves, healed."""
    e = _by_order(spark, sf_dir)
    docs = segments.segment_documents(e)
    more = e.groupBy("file_id", "segment").agg(F.array_join(F.array_sort(F.collect_set(normalize_key(F.col("date")))), "|").alias("signature"), F.max(F.col("kind") == "imaging").alias("has_imaging"), F.min_by("marker_index", "entry_seq").alias("_i"), F.max("recipient").alias("recipient"))
    ready = docs.join(more, ["file_id", "segment"]).withColumn("opens_printed", F.col("_i") == 1)
    return healing.heal_documents(ready).select("file_id", "segment", "document")


@query("""WITH n AS (SELECT file_id, entry_seq, unnest([author, recipient]) AS name, title FROM {e} e), m AS (SELECT * FROM n WHERE name IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY file_id, name ORDER BY entry_seq) AS k FROM m)
SELECT file_id, name, count(*) AS n, list(entry_seq ORDER BY entry_seq) FILTER (WHERE k <= 6) AS places FROM r GROUP BY ALL""")
def name_variants(spark, sf_dir):
    return headers.name_variants(_entries(spark, sf_dir).withColumn("raw_text_excerpt", F.col("title"))).select("file_id", "name", "n", "places")


@query("""WITH e AS (SELECT *, entry_seq <= 3 AS first FROM {e} e), a AS (SELECT file_id, min_by(author, entry_seq) FILTER (WHERE first AND author IS NOT NULL) AS author, min_by(title, entry_seq) FILTER (WHERE first AND title IS NOT NULL) AS title FROM e GROUP BY 1),
ca AS (SELECT file_id, author, count(*) AS n, min(entry_seq) AS f FROM e WHERE author IS NOT NULL GROUP BY ALL), ma AS (SELECT file_id, arg_max(author, (n, -f)) AS author FROM ca GROUP BY 1),
ct AS (SELECT file_id, title, count(*) AS n, min(entry_seq) AS f FROM e WHERE title IS NOT NULL GROUP BY ALL), mt AS (SELECT file_id, arg_max(title, (n, -f)) AS title FROM ct GROUP BY 1)
SELECT a.file_id, coalesce(a.author, ma.author) AS author, coalesce(a.title, mt.title) AS title FROM a LEFT JOIN ma ON a.file_id = ma.file_id LEFT JOIN mt ON a.file_id = mt.file_id""")
def header_fields(spark, sf_dir):
    return headers.header_fields(_entries(spark, sf_dir), ["file_id"], ["author", "title"], "entry_seq", F.col("entry_seq") <= 3)
