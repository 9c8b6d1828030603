"""Queries of lines, labels, layouts, decoded answers and what documents take from pages, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.functions import names, text
from pagegraph.functions import wording as W
from pagegraph.operators import entries as E
from pagegraph.operators import evaluation, inference, segments
from pagegraph.plans._registry import registry
from pagegraph.plans.shapes import shape
from pagegraph.session import table
from pagegraph.sources import files, layout

QUERIES, ORACLE_SQL, query = registry()


def _cases(key: Column, *values: str | None) -> Column:
    """One of the values by the key's remainder."""
    out = F.lit(values[-1])
    for k, value in enumerate(values[:-1]):
        out = F.when(key % len(values) == k, F.lit(value)).otherwise(out)
    return out


def _case_sql(key: str, *values: str | None) -> str:
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(quoted)) + " END"


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_BUCKETS = ("imaging", "pathology", "functional", "administrative", "clinical", None)
_KINDS = "CASE b WHEN 'imaging' THEN 'imaging report' WHEN 'pathology' THEN 'pathology report' WHEN 'functional' THEN 'functional report' WHEN 'administrative' THEN 'document' ELSE 'clinical note' END"
_DATE = "strftime(CAST(iso AS DATE), '%B %d, %Y')"


@query(r"""WITH r AS (SELECT doc_id, '## ' || replace(text, chr(10), chr(10) || '- ') || '  **strong**' || chr(10) || chr(10) || chr(10) || chr(10) || '> > __end__ ' AS x FROM documents)
SELECT doc_id, """ + _STRIP.format(r"regexp_replace(regexp_replace(regexp_replace(replace(replace(x, '**', ''), '__', ''), '(?m)^[*\-#>]+\s*', '', 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + " AS opinion FROM r")
def opinion_scrub(spark, sf_dir):
    raw = F.concat(F.lit("## "), F.replace("text", F.lit("\n"), F.lit("\n- ")), F.lit("  **strong**\n\n\n\n> > __end__ "))
    return table(spark, sf_dir, "documents").select("doc_id", W.scrub_opinion(raw).alias("opinion"))


@query(f"""WITH d AS (SELECT doc_pos, {_case_sql('doc_pos', *_BUCKETS)} AS b, {_case_sql('doc_pos', 'Rule type', None, None)} AS r, {_case_sql('doc_pos', '', 'Own type', None, 'x')} AS c FROM {{d}} d)
SELECT doc_pos, {_KINDS} AS kind, CASE WHEN b IN ('imaging', 'pathology', 'functional', 'administrative') THEN b ELSE 'clinical' END AS type, coalesce(r, nullif(c, ''), b) AS registered FROM d""")
def document_labels(spark, sf_dir):
    k = F.col("doc_pos")
    bucket = _cases(k, *_BUCKETS)
    return shape(spark, sf_dir, "documents_of_orders").select("doc_pos", W.kind_label(bucket).alias("kind"), W.type_label(bucket).alias("type"), W.registered_type(_cases(k, "Rule type", None, None), _cases(k, "", "Own type", None, "x"), bucket).alias("registered"))


_TITLES = ("Consent form", None, "29Jul22 Progress note", "")


def _titled(spark, sf_dir) -> DataFrame:
    k = F.col("doc_pos")
    return shape(spark, sf_dir, "documents_of_orders").withColumns({"b": _cases(k, *_BUCKETS), "title": _cases(k, *_TITLES), "shown": F.when(k % 5 != 0, F.col("iso"))})


_TITLED = f"(SELECT *, {_case_sql('doc_pos', *_BUCKETS)} AS b, {_case_sql('doc_pos', 'Consent form', None, 'Progress note', None)} AS t, CASE WHEN doc_pos % 5 <> 0 THEN {_DATE} END AS shown FROM {{d}} d) d"


@query(f"""SELECT doc_pos, CASE WHEN doc_pos % 7 = 0 THEN CASE WHEN doc_pos % 2 = 0 THEN 'Page' ELSE 'Pages' END || ' could not be read during parsing - review the source page(s) directly.'
 WHEN doc_pos % 3 <> 0 THEN CASE WHEN shown IS NULL AND t IS NULL THEN 'Administrative content only (cover/consent/billing); nothing clinical to summarize.' ELSE concat_ws(' ', shown, t) || ' - administrative content only (cover/consent/billing); nothing clinical to summarize.' END
 ELSE 'Blank or near-blank page(s); no content captured.' END AS line FROM {_TITLED}""")
def placeholder_lines(spark, sf_dir):
    k = F.col("doc_pos")
    excerpt = F.when(k % 7 == 0, "[parse-error] no answer").when(k % 7 == 1, "some text")
    line = W.placeholder_text(1 + k % 2, W.is_unreadable(excerpt), k % 3 != 0, F.col("shown"), F.col("title"))
    return _titled(spark, sf_dir).select("doc_pos", line.alias("line"))


@query(f"""WITH d AS (SELECT *, coalesce(t, CASE WHEN b = 'pathology' THEN 'lab report' ELSE {_KINDS} END) AS l FROM {_TITLED})
SELECT doc_pos, CASE WHEN shown IS NULL THEN upper(l[1:1]) || l[2:] || '.' ELSE shown || ' ' || l || '.' END AS line FROM d""")
def lab_lines(spark, sf_dir):
    return _titled(spark, sf_dir).select("doc_pos", W.lab_line(F.col("b"), F.col("shown"), F.col("title")).alias("line"))


_CAPTIONS = ("![Left knee.]", "Medical image on page; no report text captured.", "Findings: none", "  ", "![]")


@query(f"""WITH d AS (SELECT *, {_case_sql('doc_pos', *_CAPTIONS)} AS c, doc_pos % 4 = 0 AS more FROM {_TITLED}),
x AS (SELECT *, CASE doc_pos % 5 WHEN 0 THEN 'Left knee.' WHEN 1 THEN 'Medical image on page; no report text captured.' WHEN 2 THEN 'Findings: none' WHEN 3 THEN CASE WHEN more THEN 'Right hand' ELSE 'Medical image' END ELSE 'Medical image' END AS said FROM d)
SELECT doc_pos, CASE WHEN doc_pos % 5 = 2 THEN false WHEN doc_pos % 5 = 3 THEN more ELSE true END AS alone,
 rtrim(CASE WHEN shown IS NULL THEN said ELSE shown || ', ' || lower(said[1:1]) || said[2:] END, '.') || '.' AS line FROM x""")
def image_lines(spark, sf_dir):
    k = F.col("doc_pos")
    texts = F.array(_cases(k, *_CAPTIONS), F.when(k % 4 == 0, F.lit("![Right hand]")).otherwise(F.lit(" ")))
    return _titled(spark, sf_dir).select("doc_pos", W.image_only(texts).alias("alone"), W.image_line(texts, F.col("shown")).alias("line"))


@query(f"""WITH d AS (SELECT *, concat_ws(' ', CASE WHEN doc_pos % 3 = 0 THEN 'May 04, 2022' ELSE shown END, coalesce(t, {_KINDS}), CASE doc_pos % 4 WHEN 0 THEN 'by Dr. Berg' WHEN 1 THEN 'by Ann Berg' WHEN 3 THEN 'by Lee Tan' END) || '.' AS o FROM {_TITLED})
SELECT doc_pos, o AS opening, CASE doc_pos % 3 WHEN 0 THEN o || ' Pain. Stiff knee.' WHEN 1 THEN o || ' Pain.' END AS paragraph, o || CASE WHEN doc_pos % 2 = 0 THEN ' (page 3).' ELSE ' (pages 3-5).' END AS stub FROM d""")
def paragraph_openers(spark, sf_dir):
    k = F.col("doc_pos")
    opening = W.opener(F.when(k % 3 == 0, "2022-05-04"), F.col("shown"), F.col("title"), F.col("b"), _cases(k, "Ann Berg", "Ann Berg,", None, "Tan, Lee"), F.lit(False), _cases(k, "MD", None, "MD", "RN"))
    texts = F.when(k % 3 == 0, F.array(F.lit(" Pain. "), F.lit("pain"), F.lit(""), F.lit("Stiff knee"))).when(k % 3 == 1, F.array(F.lit("Pain"), F.lit("PAIN."))).otherwise(F.array(F.lit(" "), F.lit(".")))
    d = _titled(spark, sf_dir).select("doc_pos", opening.alias("opening"), texts.alias("texts"))
    return d.select("doc_pos", "opening", W.fallback_paragraph(F.col("opening"), F.col("texts")).alias("paragraph"), W.stub_line(F.col("opening"), F.lit(3), 3 + 2 * (k % 2)).alias("stub"))


_FILES = ("a/b/Scan 1.PDF", "notes.docx", "", None, ".hidden", "folder/", "x.y.TXT", "plain")


@query(f"""SELECT page_id, {_case_sql('page_id', 'Scan 1.PDF', 'notes.docx', 'upload', 'upload', '.hidden', 'folder', 'x.y.TXT', 'plain')} AS name, {_case_sql('page_id', '.pdf', '.docx', None, None, None, None, '.txt', None)} AS ending,
 CASE WHEN page_id % 3 = 0 THEN 'image/png' ELSE {_case_sql('page_id', 'application/pdf', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', 'application/octet-stream', 'application/octet-stream', 'application/octet-stream', 'application/octet-stream', 'text/plain', 'application/octet-stream')} END AS type,
 {_case_sql('page_id', 'in  out', None, 'x')} AS folder FROM pages""")
def file_name_parts(spark, sf_dir):
    k = F.col("page_id")
    name, given = _cases(k, *_FILES), _cases(k, " Image/PNG ", "application/octet-stream", None)
    return table(spark, sf_dir, "pages").select("page_id", W.file_name(name).alias("name"), W.extension(name).alias("ending"), W.content_type(name, given).alias("type"), W.folder_name(_cases(k, " in/\\out", "//", "x")).alias("folder"))


@query(r"""SELECT doc_id, regexp_extract_all(text || ' Seen ' || (doc_id % 28 + 1) || '/4/2022, 2021-03-0' || (doc_id % 9 + 1) || ', sept 2020 and May 4,2019.', '""" + W.SHOWN_DATES + r"""', 0) AS dates FROM documents""")
def highlighted_dates(spark, sf_dir):
    k = F.col("doc_id")
    body = F.concat("text", F.lit(" Seen "), (k % 28 + 1).cast("string"), F.lit("/4/2022, 2021-03-0"), (k % 9 + 1).cast("string"), F.lit(", sept 2020 and May 4,2019."))
    return table(spark, sf_dir, "documents").select("doc_id", W.shown_dates(body).alias("dates"))


_DIAGNOSES = ("Diagnosis: Left|knee  sprain. Other", "main diagnosis - torn cuff; more", "see n/a there", " | ", "", None, "diagnosis:", "a" * 60 + " " + "b" * 70)


@query(f"SELECT doc_pos, {_case_sql('doc_pos', 'Left knee sprain', 'torn cuff', 'N/A', None, '', None, 'N/A', 'a' * 60 + ' ' + 'b' * 56 + '...')} AS shown FROM {{d}} d")
def diagnosis_lines(spark, sf_dir):
    return shape(spark, sf_dir, "documents_of_orders").select("doc_pos", W.diagnosis_display(_cases(F.col("doc_pos"), *_DIAGNOSES)).alias("shown"))


@query(f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Entry ' || (event_id + 1) ELSE {_case_sql('event_id', 'x', 'Gemini page parsing batch  7', 'OpenAI patient bundle merge 2', 'Opinion')} || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' | ' || event_type END END || ' | in' AS label,
 CASE event_id % 5 WHEN 0 THEN 'LLM call ' || (event_id + 1) WHEN 1 THEN 'Page batch 7' WHEN 2 THEN 'Bundle 3' WHEN 3 THEN 'Bundle merge 2' ELSE 'Other call' END AS short FROM events""".replace("CASE WHEN event_id % 4 = 0 THEN 'Entry ' || (event_id + 1) ELSE", "CASE WHEN event_id % 4 = 0 THEN 'Entry ' || (event_id + 1) || CASE WHEN event_id % 3 = 0 THEN '' ELSE ' | ' || event_type END ELSE"))
def log_labels(spark, sf_dir):
    k = F.col("event_id")
    task = _cases(k, None, "Gemini page parsing batch  7", "OpenAI patient bundle merge 2", "Opinion")
    raw = _cases(k, " ", "Gemini page parsing batch  7", "openai patient bundle extraction 3", "OpenAI patient bundle merge  2", "Other\n call")
    return table(spark, sf_dir, "events").select("event_id", W.log_label(task, F.when(k % 3 != 0, F.col("event_type")), F.lit("in"), k).alias("label"), W.short_label(raw, k).alias("short"))


@query(f"""SELECT o_orderkey, {_case_sql('o_orderkey', 'Ready', 'Failed', 'Cancelled', 'Processing', 'Queued', 'Queued')} AS status, {_case_sql('o_orderkey', 'Parse', 'LLM', 'export')} AS stage, CAST((greatest(o_orderkey % 20, 1) - 1) % 8 AS INTEGER) AS colour FROM orders""")
def state_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", W.status_label(_cases(k, "completed", "failed", "cancelled", "processing", "queued", None)).alias("status"), W.stage_label(_cases(k, "parse", "summarize", "export")).alias("stage"), W.colour(k % 20).alias("colour"))


@query("""SELECT file_id, entry_seq, coalesce(n_evidence % 3 <> 1, true) AS first_hand, kind = 'imaging' AND title IS NULL AND author IS NULL AND date IS NULL AS bare FROM {e} e""")
def page_predicates(spark, sf_dir):
    e = shape(spark, sf_dir, "entries")
    said = F.when(F.col("n_evidence") % 3 == 1, "referenced").when(F.col("n_evidence") % 3 == 0, "primary")
    return e.select("file_id", "entry_seq", W.is_first_hand(said).alias("first_hand"), W.is_bare_image(F.col("kind"), F.col("title"), F.col("author"), F.col("date")).alias("bare"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'job_' || sha256(CAST(event_id AS STRING))[1:12] AS id FROM events""")
def times_and_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", W.iso_utc(F.col("ts")).alias("stamp"), W.made_id("job", F.col("event_id")).alias("id"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'plain' WHEN 2 THEN 'a' || chr(10) || event_type WHEN 3 THEN '' END AS said FROM events""")
def model_texts(spark, sf_dir):
    k = F.col("event_id")
    parts = F.concat(F.lit('{"content": ["a", {"type": "image", "text": "no"}, {"type": "text", "text": "'), "event_type", F.lit('"}]}'))
    raw = F.when(k % 5 == 0, F.to_json(F.struct(F.col("props").alias("text")))).when(k % 5 == 1, F.lit('{"content": "plain"}')).when(k % 5 == 2, parts).when(k % 5 == 3, F.lit('{"content": []}')).otherwise(F.lit('{"other": 1}'))
    return table(spark, sf_dir, "events").select("event_id", W.model_text(raw).alias("said"))


@query(r"""WITH r AS (SELECT source, unnest([' ' || lang || '  type ', lang || ' type', '', source]) AS n FROM documents),
c AS (SELECT DISTINCT source, trim(regexp_replace(n, '\s+', ' ', 'g')) AS n FROM r WHERE n IS NOT NULL) SELECT source, list(n ORDER BY n) AS names FROM c WHERE n <> '' GROUP BY source""")
def distinct_names(spark, sf_dir):
    from pagegraph.operators.listings import collapsed_names

    raw = F.array(F.concat(F.lit(" "), "lang", F.lit("  type ")), F.concat("lang", F.lit(" type")), F.lit(""), F.col("source"))
    return collapsed_names(table(spark, sf_dir, "documents").select("source", F.explode(raw).alias("n")), "source", "n")


# What documents take from their pages

_SEGMENT = "SELECT *, CAST(dense_rank() OVER (PARTITION BY file_id ORDER BY order_key) AS INTEGER) AS segment FROM {e} e"


def _by_order(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    return shape(spark, sf_dir, "entries").withColumn("segment", F.dense_rank().over(Window.partitionBy("file_id").orderBy("order_key")))


@query(f"WITH s AS ({_SEGMENT}), m AS (SELECT *, CAST((segment + 1) // 2 AS INTEGER) AS document FROM s),"
       """ o AS (SELECT file_id, document, min_by(title, entry_seq) FILTER (WHERE title IS NOT NULL AND segment % 2 = 1) AS t0, min_by(title, entry_seq) FILTER (WHERE title IS NOT NULL) AS t1,
 min_by(author, entry_seq) FILTER (WHERE author IS NOT NULL) AS a1, min_by(bucket, entry_seq) FILTER (WHERE bucket <> 'unknown') AS b1 FROM m GROUP BY ALL)
SELECT file_id, document, coalesce(t1, t0) AS title, coalesce(a1, 'Nobody') AS author, coalesce(b1, 'unknown') AS bucket FROM o""")
def refreshed_metadata(spark, sf_dir):
    e = _by_order(spark, sf_dir).withColumn("document", F.floor((F.col("segment") + 1) / 2).cast("int"))
    anchor = e.where("segment % 2 = 1").groupBy("file_id", "document").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("entry_seq"))).alias("title"))
    none = F.lit(None).cast("string")
    docs = anchor.withColumns({"date": none, "custom_type": none, "recipient": none, "author": F.lit("Nobody"), "bucket": F.lit("unknown")})
    return segments.refreshed_documents(docs, e).select("file_id", "document", "title", "author", "bucket")


@query(f"WITH s AS ({_SEGMENT}), " + """v AS (SELECT *, CASE WHEN kind NOT IN ('empty', 'signature_only') THEN date END AS d, CASE WHEN kind NOT IN ('empty', 'signature_only') THEN author END AS a FROM s),
b AS (SELECT *, coalesce(d <> last_value(d IGNORE NULLS) OVER w, false) OR coalesce(a <> last_value(a IGNORE NULLS) OVER w, false) AS b FROM v WINDOW w AS (PARTITION BY file_id, segment ORDER BY entry_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, segment ORDER BY entry_seq) AS sub FROM b)
SELECT file_id, 'doc-' || segment || '::' || sub AS sub_id, min_by(date, entry_seq) FILTER (WHERE date IS NOT NULL) AS date, min_by(author, entry_seq) FILTER (WHERE author IS NOT NULL) AS author,
 coalesce(min_by(bucket, entry_seq) FILTER (WHERE bucket <> 'unknown'), 'unknown') AS bucket, min_by(page_number, entry_seq) AS page_start, max_by(page_number, entry_seq) AS page_end, count(*) AS n_entries FROM n GROUP BY file_id, segment, sub""")
def subsection_rows(spark, sf_dir):
    rows = segments.subsection_rows(segments.subsections(_by_order(spark, sf_dir)))
    return rows.select("file_id", "sub_id", "date", "author", "bucket", "page_start", "page_end", "n_entries")


@query()
def subsections_by_likeness(spark, sf_dir):
    return segments.subsections_by_likeness(_by_order(spark, sf_dir)).select("file_id", "entry_seq", "sub")


@query(f"WITH s AS ({_SEGMENT}) " + """SELECT file_id, segment, coalesce(string_agg(nullif(trim(title), ''), chr(10) || chr(10) ORDER BY entry_seq), '') AS markdown FROM s GROUP BY ALL""")
def document_markdown(spark, sf_dir):
    return segments.page_markdown(_by_order(spark, sf_dir).withColumn("markdown", F.concat(F.lit(" "), "title", F.lit("  "))), ["file_id", "segment"], "entry_seq")


@query(f"WITH s AS ({_SEGMENT}), x AS (SELECT file_id, segment, entry_seq, k, author, date FROM s, (VALUES (0), (1)) v(k) WHERE n_evidence > 0)"
       """ SELECT file_id, segment, coalesce(string_agg(CASE k WHEN 0 THEN coalesce(author, '-') ELSE coalesce(date, '-') END, '|' ORDER BY entry_seq, k) FILTER (WHERE k IS NOT NULL), '') AS said FROM s LEFT JOIN x USING (file_id, segment, entry_seq) GROUP BY ALL""".replace("coalesce(author, '-')", "coalesce(x.author, '-')").replace("coalesce(date, '-')", "coalesce(x.date, '-')"))
def document_evidence(spark, sf_dir):
    items = F.when(F.col("n_evidence") > 0, F.array(F.struct(F.coalesce("author", F.lit("-")).alias("text")), F.struct(F.coalesce("date", F.lit("-")).alias("text"))))
    got = segments.all_evidence(_by_order(spark, sf_dir).withColumn("evidence", items), ["file_id", "segment"], "entry_seq")
    return got.select("file_id", "segment", F.array_join(F.transform("evidence", lambda e: e["text"]), "|").alias("said"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM conversations), n AS (SELECT *, bool_or(pos % 3 = 0) OVER (PARTITION BY conv_id) AS nested FROM c),
x AS (SELECT *, pos % 3 = 0 AS many, unnest(CASE WHEN pos % 3 = 0 THEN [0, 1] ELSE [0] END) AS k FROM n),
m AS (SELECT *, CASE WHEN many THEN 1 WHEN pos % 4 <> 0 AND pos % 5 <> 0 THEN 1 ELSE 0 END AS counts FROM x)
SELECT conv_id, CAST(pos AS INTEGER) AS para_pos, CAST(k AS INTEGER) AS sub_pos, CASE WHEN many THEN 'part ' || k ELSE text END AS text,
 CAST(CASE WHEN nested AND counts = 1 THEN sum(counts) OVER (PARTITION BY conv_id ORDER BY pos, k) ELSE CASE WHEN pos % 5 = 0 THEN 0 ELSE pos * 10 END END AS INTEGER) AS document_number FROM m""")
def flattened_entries(spark, sf_dir):
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    c = table(spark, sf_dir, "conversations").withColumn("para_pos", pos)
    subs = F.array(*[F.struct(F.lit(f"part {k}").alias("text"), F.col("para_pos").alias("page_start"), F.col("para_pos").alias("page_end")) for k in (0, 1)])
    rows = c.select(F.col("conv_id").alias("patient"), "para_pos", "text", F.col("para_pos").alias("page_start"), F.col("para_pos").alias("page_end"), F.lit("d").alias("document_id"), F.lit("t").alias("document_type"), F.when(F.col("para_pos") % 5 == 0, 0).otherwise(F.col("para_pos") * 10).alias("document_number"), (F.col("para_pos") % 4 == 0).alias("is_placeholder"), F.when(F.col("para_pos") % 3 == 0, subs).otherwise(F.slice(subs, 1, 0)).alias("subs"))
    return segments.flattened_entries(rows).select(F.col("patient").alias("conv_id"), "para_pos", "sub_pos", "text", "document_number")


@query("""WITH e AS (SELECT file_id, order_key, min(page_number) AS ps, max(page_number) AS pe, lower('Seen ' || max(order_date) || ' by ' || coalesce(min(author), 'nobody') || ': ' || max(bucket)) AS said FROM {e} e GROUP BY 1, 2),
t(trap_id, kind) AS (VALUES ('near', 'phrase_near_date'), ('who', 'forbidden_author'), ('page', 'phrase_on_page'))
SELECT file_id, trap_id, kind, count(*) AS n FROM e, t WHERE CASE kind WHEN 'phrase_near_date' THEN contains(said, '199') AND (contains(said, 'imaging') OR contains(said, 'no such')) WHEN 'forbidden_author' THEN ps <= 3 AND pe >= 2 AND (contains(said, 'by supplier 3x') OR contains(said, 'by nobody')) ELSE ps <= 3 AND pe >= 2 AND (contains(said, 'imaging') OR contains(said, 'clinical')) END GROUP BY ALL""".replace("ps <= 3 AND pe >= 2", "len(list_filter([2, 3], lambda p: p BETWEEN ps AND pe)) > 0"))
def text_traps(spark, sf_dir):
    said = F.concat(F.lit("Seen  "), F.max("order_date"), F.lit("\nby "), F.coalesce(F.min("author"), F.lit("Nobody")), F.lit(": "), F.max("bucket"))
    got = shape(spark, sf_dir, "entries").groupBy("file_id", "order_key").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), said.alias("text"))
    kinds = [("near", "phrase_near_date", "199", ["IMAGING", "no such"]), ("who", "forbidden_author", None, ["Supplier 3x", "NOBODY"]), ("page", "phrase_on_page", None, ["imaging", "Clinical"])]
    listed = spark.createDataFrame([(*k, [2, 3]) for k in kinds], "trap_id string, kind string, date string, forbidden array<string>, pages array<int>")
    traps = got.select("file_id").distinct().crossJoin(F.broadcast(listed))  # three traps for each file
    return evaluation.text_traps(got.withColumn("x", F.lit(1)), traps).select("file_id", "trap_id", "kind", "n")


@query("""WITH e AS (SELECT file_id, order_key, min(page_number) AS ps, max(page_number) AS pe FROM {e} e GROUP BY 1, 2), t AS (SELECT DISTINCT file_id, CAST(file_id % 7 + 1 AS INTEGER) AS l FROM {e} e)
SELECT e.file_id, 'apart' AS trap_id, count(*) AS n FROM e JOIN t ON e.file_id = t.file_id AND ps <= l + 1 AND pe >= l AND ps <= l + 3 AND pe >= l + 2 GROUP BY 1""")
def separate_traps(spark, sf_dir):
    got = shape(spark, sf_dir, "entries").groupBy("file_id", "order_key").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"))
    left = (F.col("file_id") % 7 + 1).cast("int")
    traps = got.select("file_id").distinct().select("file_id", F.lit("apart").alias("trap_id"), left.alias("left_start"), (left + 1).alias("left_end"), (left + 2).alias("right_start"), (left + 3).alias("right_end"))
    return evaluation.spanning_entries(got, traps)


@query("""WITH e AS (SELECT file_id, order_key, min(page_number) AS ps, max(page_number) AS pe, max(bucket) AS b, bool_or(include) AS i FROM {e} e GROUP BY 1, 2)
SELECT k.file_id, k.order_key AS key_id, list_sort(list_distinct(list(lower(e.b)))) AS types FROM e k JOIN e ON k.file_id = e.file_id AND e.i AND e.ps <= k.pe AND e.pe >= k.ps GROUP BY ALL""")
def visible_types(spark, sf_dir):
    e = shape(spark, sf_dir, "entries").groupBy("file_id", "order_key").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.upper(F.max("bucket")).alias("registered_type"), F.max("include").alias("include"))
    return evaluation.visible_types(e.where("include"), e.select("file_id", F.col("order_key").alias("key_id"), "page_start", "page_end"))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 7 AS a, s_suppkey % 5 AS b FROM supplier), k AS (SELECT s_suppkey, ['t' || a, 'u' || b] AS x, CASE WHEN s_suppkey % 4 = 0 THEN [] ELSE ['t' || (s_suppkey % 3)] END AS y FROM s)
SELECT s_suppkey, CAST(len(list_intersect(x, y)) AS INTEGER) AS shared, len(y) > 0 AND (len(list_filter(x, lambda t: NOT list_contains(y, t))) = 0 OR len(list_filter(y, lambda t: NOT list_contains(x, t))) = 0) AS within FROM k""")
def name_token_sets(spark, sf_dir):
    k = F.col("s_suppkey")
    a = F.concat(F.lit("t"), (k % 7).cast("string"), F.lit("|u"), (k % 5).cast("string"))
    b = F.when(k % 4 != 0, F.concat(F.lit("t"), (k % 3).cast("string"))).otherwise("")
    return table(spark, sf_dir, "supplier").select("s_suppkey", names.tokens_shared(a, b).alias("shared"), names.tokens_within(a, b).alias("within"))


# Layouts and answers


@query("""WITH c AS (SELECT l_orderkey AS p, CAST(l_linenumber % 3 AS INTEGER) AS r, CAST(l_partkey % 4 AS INTEGER) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, CASE WHEN l_partkey % 5 <> 0 THEN l_shipdate::DATE::VARCHAR END AS t, l_linenumber % 3 = 0 AND l_suppkey % 2 = 0 AS h FROM lineitem),
k AS (SELECT p, r, c, arg_max(coalesce(t, ''), n) AS t FROM c GROUP BY ALL), w AS (SELECT p, r, string_agg(t, '|' ORDER BY c) AS line FROM k GROUP BY ALL), z AS (SELECT p, string_agg(line, ';' ORDER BY r) AS lines FROM w GROUP BY p)
SELECT z.p AS page, lines, coalesce((SELECT string_agg(coalesce(t, ''), '|' ORDER BY n) FROM c WHERE c.p = z.p AND h), '') AS headers FROM z""")
def cell_tables(spark, sf_dir):
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_number"), F.lit(1).alias("table_id"), (F.col("l_linenumber") % 3).alias("row_index"), (F.col("l_partkey") % 4).cast("int").alias("column_index"), seq.alias("cell_seq"), F.when(F.col("l_partkey") % 5 != 0, F.to_date("l_shipdate").cast("string")).alias("content"), F.when(F.col("l_suppkey") % 2 == 0, "columnHeader").alias("kind"))
    t = layout.cell_tables(cells)
    return t.select(F.col("page_number").alias("page"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("lines"), F.array_join("headers", "|").alias("headers"))


_LABELS = ("Family Physican", "Accession No", "CC:", "Provided care", "Provider", "Ordering-Physician", "Referred_by", "CC/Attn", "Copy of", "Delivered  To", None, "")
_IS_ROUTING = (True, False, True, False, True, True, True, True, False, True, False, False)


@query(f"SELECT o_orderkey, list_contains([{', '.join(str(k) for k, r in enumerate(_IS_ROUTING) if r)}], o_orderkey % {len(_LABELS)}) AS routing FROM orders")
def routing_labels(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return inference.with_routing(o.select("o_orderkey", _cases(F.col("o_orderkey"), *_LABELS).alias("label"))).select("o_orderkey", "routing")


@query("""WITH l AS (SELECT page_id, CAST(page_id % 30 AS INTEGER) AS n, page_id % 4 <> 0 AS ok, page_id % 3 = 0 AS filled FROM pages),
b AS (SELECT page_id, 'Layout of page ' || page_id || CASE WHEN filled AND n > 0 THEN chr(10) || chr(10) || 'Tables (rows are entries of a list, not documents):' || chr(10) || 'TABLE 1 (' || n || ' row(s)):' || chr(10) || '  columns: Date | Test' || chr(10)
 || array_to_string(list_transform(list_filter(range(1, least(n, 25) + 1), lambda k: k % 5 <> 0), lambda k: '  row: r' || k || ' | x y'), chr(10)) || CASE WHEN n > 25 THEN chr(10) || '  ... ' || (n - 25) || ' further row(s) not shown' ELSE '' END ELSE '' END
 || chr(10) || chr(10) || 'Fields of routing (never the author):' || chr(10) || '  "CC": Dr. A' || CASE WHEN n > 0 THEN chr(10) || chr(10) || 'Fields:' || chr(10) || array_to_string(list_transform(range(1, least(2 * n, 40) + 1), lambda k: '  "f' || k || '": v'), chr(10)) ELSE '' END AS block, ok FROM l)
SELECT page_id, CASE WHEN ok THEN block ELSE '' END AS block FROM b""")
def layout_blocks(spark, sf_dir):
    n = (F.col("page_id") % 30).cast("int")
    rows = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.when(k % 5 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.concat(F.lit("r"), k.cast("string")), F.lit(" x  y "))))
    tables = F.array(F.struct(F.array(F.lit("Date"), F.lit(" "), F.lit("Test")).alias("headers"), F.when(F.col("page_id") % 3 == 0, rows).otherwise(F.array(F.array(F.lit(" ")))).alias("rows")))
    more = F.transform(F.when(n > 0, F.sequence(F.lit(1), 2 * n)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.concat(F.lit("f"), k.cast("string")).alias("label"), F.lit("v").alias("value")))
    fields = F.concat(F.array(F.struct(F.lit("CC").alias("label"), F.lit(" Dr.  A ").alias("value")), F.struct(F.lit("").alias("label"), F.lit("lost").alias("value"))), more)
    return layout.layout_blocks(table(spark, sf_dir, "pages").select(F.col("page_id").alias("page_number"), (F.col("page_id") % 4 != 0).alias("analyzed"), tables.alias("tables"), fields.alias("fields"))).select(F.col("page_number").alias("page_id"), "block")


@query("""SELECT page_id, page_id % 4 <> 0 AS analyzed, CASE WHEN page_id % 4 = 0 THEN false ELSE page_id % 3 <> 0 END AS informative FROM pages""")
def layout_answers(spark, sf_dir):
    k = F.col("page_id")
    answer = F.when(k % 3 == 0, '{"tables": [{"headers": [], "rows": [[" "]]}], "fields": [{"label": "a", "value": " "}]}').when(k % 3 == 1, '{"tables": [{"headers": [], "rows": [["x"]]}], "fields": []}').otherwise('{"tables": [], "fields": [{"label": "a", "value": "b"}]}')
    got = layout.analysed(table(spark, sf_dir, "pages").select(k.alias("page_number"), answer.alias("answer"), F.when(k % 4 == 0, "timeout").alias("error")))
    return got.select(F.col("page_number").alias("page_id"), "analyzed", layout.is_informative(F.col("tables"), F.col("fields")).alias("informative"))


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'empty' WHEN 1 THEN 'clinical' WHEN 2 THEN 'imaging' WHEN 3 THEN 'imaging' WHEN 4 THEN 'admin' ELSE 'clinical' END AS kind, CASE WHEN k IN (1, 5) THEN 'pathology' ELSE 'unknown' END AS bucket, k NOT IN (0, 4) AS include,
 CASE k WHEN 1 THEN 'finding:A b:referenced|score:C:primary' WHEN 2 THEN 'imaging_finding:Knee:primary' WHEN 3 THEN 'imaging_finding:Some text:primary' WHEN 5 THEN 'onset:x:primary' ELSE '' END AS evidence, k = 0 AS parse_error FROM d""")
def decoded_pages(spark, sf_dir):
    k = F.col("doc_id") % 6
    answer = (
        F.when(k == 0, "no JSON {").when(k == 1, 'Here: {"page_kind": " Clinical ", "document": {"bucket": "PATHOLOGY"}, "evidence": [{"kind": "Finding", "text": " A  b ", "provenance": "referenced"}, {"kind": "gossip", "text": "x"}, {"kind": "exam", "text": " "}, {"kind": "score", "text": "C", "provenance": "heard"}]} done')
        .when(k == 2, '```json\n{"page_kind": "empty", "include_in_output": false, "markdown": "![Knee] ", "evidence": []}\n```').when(k == 3, '{"page_kind": "imaging", "raw_text_excerpt": "Some  text"}').when(k == 4, '{"page_kind": "admin", "document": {"bucket": "other"}}').otherwise('{"page_kind": "weird", "document": {"bucket": "pathology"}, "evidence": [{"kind": "onset", "text": "x"}]}')
    )
    got = files.decoded_pages(table(spark, sf_dir, "documents").select("doc_id", F.lit("f").alias("file_id"), F.lit(1).alias("page_number"), answer.alias("answer")).withColumn("file_id", F.col("doc_id")))
    said = F.array_join(F.transform(F.coalesce("evidence", F.array().cast("array<struct<kind:string,text:string,value:string,provenance:string>>")), lambda e: F.concat_ws(":", e["kind"], e["text"], e["provenance"])), "|")
    return got.select(F.col("file_id").alias("doc_id"), "kind", "bucket", "include", said.alias("evidence"), "parse_error")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN event_id WHEN 2 THEN event_id WHEN 3 THEN event_id END AS k, event_id % 6 >= 4 AS failed FROM events""")
def json_lenient_forms(spark, sf_dir):
    """JSON as it stands, in a fence, in prose, and as an array in prose; broken and blank answers."""
    k = F.col("event_id")
    one = F.concat(F.lit('{"k": '), k.cast("string"), F.lit("}"))
    raw = F.when(k % 6 == 0, one).when(k % 6 == 1, F.concat(F.lit("So:\n```JSON\n"), one, F.lit("\n```"))).when(k % 6 == 2, F.concat(F.lit("It is "), one, F.lit("."))).when(k % 6 == 3, F.concat(F.lit("List: ["), k.cast("string"), F.lit("] - all"))).when(k % 6 == 4, F.lit("{broken")).otherwise(F.lit(""))
    e = table(spark, sf_dir, "events").select("event_id", text.json_lenient(raw, "k bigint").alias("o"), text.json_lenient(F.when(k % 6 == 3, raw), "array<bigint>").alias("a"))
    got = F.coalesce("o.k", F.get("a", F.lit(0)))
    return e.select("event_id", got.alias("k"), got.isNull().alias("failed"))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS dark, doc_id % 3 = 0 AS told FROM documents) SELECT doc_id, CASE WHEN NOT told AND dark >= 2 THEN 'imaging' ELSE 'empty' END AS kind, NOT told AND dark >= 2 AS include,
 CASE WHEN told THEN 'seen' WHEN dark = 2 THEN 'Hand' WHEN dark = 3 THEN 'Medical image on page; no report text captured.' END AS said FROM d""")
def rescued_images(spark, sf_dir):
    k = F.col("doc_id")
    # A page with so many tenths of dark pixels; 199 is dark, 200 is not.
    histogram = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.when(i == 199, (k % 4) * 10).when(i == 200, 100 - (k % 4) * 10).otherwise(0).cast("bigint"))
    items = F.array(F.struct(F.lit("exam").alias("kind"), F.lit("seen").alias("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("empty").alias("kind"), F.lit(False).alias("include"), F.when(k % 4 == 2, "a ![ Hand ](x)").otherwise("").alias("markdown"), F.when(k % 3 == 0, items).otherwise(F.slice(items, 1, 0)).alias("evidence"), histogram.alias("histogram"))
    return layout.rescued_images(rows).select("doc_id", "kind", "include", F.get("evidence", F.lit(0))["text"].alias("said"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Call' ELSE text END AS said, turn % 2 = 0 OR trim(text) <> '' AS kept, CASE WHEN turn % 3 = 0 THEN NOT (turn % 2 = 0 OR trim(text) <> '') = false ELSE true END AS include FROM (SELECT conv_id, turn, 'w' || (conv_id % 9) AS text, role FROM conversations)""")
def scrubbed_entries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = F.when(F.col("turn") % 2 == 0, F.lit("Call 416-555-1234")).otherwise(F.concat(F.lit("w"), (F.col("conv_id") % 9).cast("string")))
    rows = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "admin").otherwise("clinical").alias("kind"), F.lit(True).alias("include"), F.lit("x").alias("raw_text_excerpt"), F.array(F.struct(F.lit("exam").alias("kind"), said.alias("text")), F.struct(F.lit("exam").alias("kind"), F.lit(" 416-555-1234 ").alias("text"))).alias("evidence"))
    got = E.scrub_entries(rows)
    return got.select("conv_id", "turn", F.get("evidence", F.lit(0))["text"].alias("said"), (F.size("evidence") == 1).alias("kept"), "include")


@query("SELECT doc_id, '{\"a\":[{\"base64\":\"<' || length(text) || ' characters, sha256 ' || sha256(text) || '>\"}],\"n\":1}' AS shown FROM documents")
def loggable_values(spark, sf_dir):
    raw = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("base64"))).alias("a"), F.lit(1).alias("n")))
    return table(spark, sf_dir, "documents").select("doc_id", inference.loggable_json(raw).alias("shown"))


class _Lowercase:
    """Clusters of names that differ in case only; fails where a file has fewer than three names."""

    def complete(self, prompt: str) -> str:
        import json

        known = [n["name"] for n in json.loads(prompt)["names"]]
        if len(known) < 3:
            raise ValueError("too few")
        return json.dumps({"clusters": [{"canonical": min(g), "members": sorted(g)} for g in ([n for n in known if n.lower() == k] for k in sorted({n.lower() for n in known}))]})


@query("""WITH e AS (SELECT DISTINCT file_id, unnest([author, upper(author)]) AS name FROM {e} e WHERE author IS NOT NULL), n AS (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM e)
SELECT file_id, name, CASE WHEN n >= 3 THEN min(name) OVER (PARTITION BY file_id, lower(name)) ELSE name END AS canonical FROM n""")
def identity_clusters(spark, sf_dir):
    from pagegraph.operators import linkage

    e = shape(spark, sf_dir, "entries").where("author is not null")
    known = e.select("file_id", F.explode(F.array(F.col("author"), F.upper("author"))).alias("name")).groupBy("file_id", "name").agg(F.count("*").alias("n"))
    answers = inference.infer(inference.identity_prompts(known), "prompt", _Lowercase(), tries=1, required=inference.required_fields("identities"))
    renames = linkage.rename_map(inference.identity_clusters(answers), known)
    return linkage.renamed(known.withColumn("canonical", F.col("name")).select("file_id", "name", "canonical"), renames, "canonical").select("file_id", "name", "canonical")


class _Opinion:
    """An opinion that corrects the occupation, in some answers without the fields that are asked for."""

    def complete(self, prompt: str) -> str:
        import json

        k = int(prompt)
        return json.dumps({"definition": "x"} if k % 3 == 0 else {"header": {"occupation": f" job {k % 5} " if k % 2 else ""}, "definition": "**Def**", "opinion": "- so"})


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 2 = 1 THEN 'job ' || (c_custkey % 5) ELSE 'clerk' END AS occupation, CASE WHEN c_custkey % 3 = 0 THEN 'No patient opinion generated.' ELSE 'Def' END AS definition, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'so' END AS opinion FROM customer""")
def opinion_headers(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bundle_id"), F.lit("clerk").alias("occupation"))
    answers = inference.infer(c.select("bundle_id", F.col("bundle_id").cast("string").alias("prompt")), "prompt", _Opinion(), tries=1, required=inference.required_fields("opinion"))
    return inference.with_opinions(c, answers, ["occupation"]).select(F.col("bundle_id").alias("c_custkey"), "occupation", "definition", "opinion")
