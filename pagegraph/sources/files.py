"""Readers and writers: logs of JSON lines, layouts, binary files, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegraph.functions.text import first_image_caption, json_lenient

# Domains of decoded fields, and what an unknown one becomes; limits of rendered tables.
PAGE_KINDS = ("clinical", "imaging", "pathology", "functional", "admin", "signature_only", "empty")
BUCKETS = ("clinical", "imaging", "pathology", "functional", "administrative", "unknown")
PROVENANCES = ("primary", "referenced", "recited", "administrative")
TABLE_ROWS, CELL_CHARS, FIELD_COUNT = 25, 120, 40
STAGES = ("parse", "summarize")
EVIDENCE_KINDS = ("diagnosis", "symptom", "finding", "measurement", "medication", "history", "exam", "impression", "imaging_finding", "imaging_impression", "recommendation", "restriction", "limitation", "return_to_work", "hospitalization", "onset", "mechanism", "investigation", "score", "checklist")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a log of JSON lines; blank lines are left out, and a bad one has parse_error and the raw text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return decode_log(lines, schema)


def decode_log(lines: DataFrame, schema: str) -> DataFrame:
    """The same for lines that are there already (column value, and any others)."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("_p", parsed)
    bad = F.col("_p._bad").isNotNull() | F.col("_p").isNull()
    fields = [c.strip().split(" ")[0] for c in schema.split(",")]
    return out.select(*[c for c in lines.columns if c != "value"], *[F.when(~bad, F.col(f"_p.{f}")).alias(f) for f in fields], bad.alias("parse_error"), F.when(bad, F.col("value")).alias("raw"))


def write_log(rows: DataFrame, path: str) -> None:
    """Appends entries to a log, one folder for each job and stage."""
    rows.write.mode("append").partitionBy("job_id", "stage").json(path)


#: Folders of a log of many jobs.
LOG_FOLDERS = 32


def write_logs(rows: DataFrame, path: str, folders: int = LOG_FOLDERS) -> None:
    """Appends entries of many jobs to a log, all of one job to one folder; job and stage stand in each line.

    The number of folders and files does not follow the number of jobs, as it does in ``write_log``, so listing and
    opening them does not take over. Rows are not shuffled: a job of very many entries is written by all tasks.
    """
    rows.withColumn("folder", F.pmod(F.xxhash64("job_id"), F.lit(folders))).write.mode("append").partitionBy("folder").json(path)


def read_logs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """job_id, stage and the fields of schema of the entries of ``write_logs``, with parse_error and raw as in ``read_log``."""
    return read_log(spark, path, f"job_id string, stage string, {schema}").drop("folder")


#: What an answer about a page looks like.
PAGE = "page_kind string, include_in_output boolean, starts_new_document boolean, page_marker struct<index:int,total:int>, document struct<title:string,bucket:string,date:string,custom_type:string>, author struct<name:string,credentials:string,is_doctor:boolean>, evidence array<struct<kind:string,text:string,value:string,provenance:string>>, raw_text_excerpt string, markdown string"


def _one_of(value: Column, known: tuple[str, ...], other: str) -> Column:
    low = F.lower(F.trim(value))
    return F.when(low.isin(*known), low).otherwise(other)


def _said(value: Column) -> Column:
    """Single blanks, null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(value, r"\s+", " ")), F.lit(""))


def decode_page(raw: Column) -> dict[str, Column]:
    """The fields of a page's answer (see PAGE), with values out of their domain replaced and evidence that says nothing left out.

    A page without evidence that has an image in its markdown is an image if it was called empty or signed only; an
    image without evidence gets one item, its caption, else its excerpt.
    """
    kind = _one_of(raw["page_kind"], PAGE_KINDS, "clinical")
    items = F.coalesce(raw["evidence"], F.array().cast("array<struct<kind:string,text:string,value:string,provenance:string>>"))
    tidy = F.transform(items, lambda e: F.struct(F.lower(F.trim(e["kind"])).alias("kind"), _said(e["text"]).alias("text"), _said(e["value"]).alias("value"), _one_of(e["provenance"], PROVENANCES, "primary").alias("provenance")))
    kept = F.filter(tidy, lambda e: e["kind"].isin(*EVIDENCE_KINDS) & e["text"].isNotNull())
    markdown = F.trim(F.coalesce(raw["markdown"], F.lit("")))
    rescued = (F.size(kept) == 0) & markdown.contains("![") & kind.isin("empty", "signature_only")
    shown = F.when(rescued, "imaging").otherwise(kind)
    caption = F.coalesce(F.nullif(first_image_caption(markdown), F.lit("")), _said(raw["raw_text_excerpt"]), F.lit("Medical image on page; no report text captured."))
    alone = F.array(F.struct(F.lit("imaging_finding").alias("kind"), caption.alias("text"), F.lit(None).cast("string").alias("value"), F.lit("primary").alias("provenance")))
    return {
        "kind": shown, "bucket": _one_of(raw["document"]["bucket"], BUCKETS, "unknown"), "include": rescued | F.coalesce(raw["include_in_output"], ~shown.isin("admin", "empty")),
        "starts_new": F.coalesce(raw["starts_new_document"], F.lit(False)), "marker_index": F.coalesce(raw["page_marker"]["index"], F.lit(0)), "marker_total": F.coalesce(raw["page_marker"]["total"], F.lit(0)),
        "title": _said(raw["document"]["title"]), "date": _said(raw["document"]["date"]), "custom_type": _said(raw["document"]["custom_type"]), "author": _said(raw["author"]["name"]),
        "evidence": F.when((shown == "imaging") & (F.size(kept) == 0), alone).otherwise(kept), "raw_text_excerpt": F.coalesce(_said(raw["raw_text_excerpt"]), F.lit("")), "markdown": markdown,
    }


def decoded_pages(answers: DataFrame) -> DataFrame:
    """page rows (file_id, page_number and the fields of ``decode_page``) from answers (file_id, page_number, answer), and parse_error.

    An answer that is no JSON is an empty page that is left out, with the reason in its excerpt.
    """
    told = answers.withColumn("_t", json_lenient(F.coalesce("answer", F.lit("")), PAGE))
    bad = F.col("_t").isNull()
    fields = decode_page(F.col("_t"))
    empty = {"kind": F.lit("empty"), "include": F.lit(False), "raw_text_excerpt": F.lit("[parse-error]"), "bucket": F.lit("unknown"), "starts_new": F.lit(False), "markdown": F.lit("")}
    out = {c: F.when(bad, empty[c]).otherwise(v) if c in empty else F.when(~bad, v) for c, v in fields.items()}
    return told.select("file_id", "page_number", *[v.alias(c) for c, v in out.items()], bad.alias("parse_error"))


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """Folder, number of files, bytes and newest time of the logs below a path, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.groupBy(folder.alias("run")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest")).orderBy(F.col("newest").desc())


def safe_run(run_id: Column) -> Column:
    """A run id that cannot leave its folder."""
    return run_id.rlike(r"^job_[^/\\]+$") & ~run_id.contains("..")


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with content and digest, newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("sha256", F.sha2("content", 256)).orderBy(F.col("modificationTime").desc())


def import_new(known: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """known, and the legacy rows whose key it does not have."""
    return known.unionByName(legacy.dropDuplicates([key]).join(known.select(key), key, "left_anti"), allowMissingColumns=True)


def encrypted(content: Column, key: Column) -> Column:
    """AES-GCM (S12); not the format of older blobs."""
    return F.aes_encrypt(content, key)


def decrypted(content: Column, key: Column) -> Column:
    """Null where the key or content does not fit."""
    return F.try_aes_decrypt(content, key)


def layout_tables(blocks: DataFrame) -> DataFrame:
    """Rows of cells of each table, from a flat list of blocks with ids and relations.

    blocks: page_number, id, block_type, text, row_index, column_index, children (ids). Missing cells are closed up.
    """
    kids = blocks.select("page_number", F.col("id").alias("parent"), F.posexplode("children").alias("pos", "id"))
    words = kids.join(blocks.where("block_type in ('WORD', 'SELECTION_ELEMENT')").select("page_number", "id", "text"), ["page_number", "id"])
    text = words.groupBy("page_number", "parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("cell"))
    cells = blocks.where("block_type = 'CELL'").select("page_number", "id", "row_index", "column_index")
    filled = cells.join(text.withColumnRenamed("parent", "id"), ["page_number", "id"], "left")
    owned = kids.select("page_number", F.col("parent").alias("table_id"), "id").join(filled, ["page_number", "id"])
    rows = owned.groupBy("page_number", "table_id", "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_index", F.coalesce("cell", F.lit("")).alias("cell")))), lambda x: x["cell"]).alias("cells"))
    return rows.groupBy("page_number", "table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "cells"))), lambda x: x["cells"]).alias("rows"))


def table_lines(rows: Column) -> Column:
    """Lines of a table, cells collapsed and cut, with a remark on rows beyond the limit."""
    def cell(x: Column) -> Column:
        return F.left(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(CELL_CHARS))

    said = F.filter(F.slice(rows, 1, TABLE_ROWS), lambda r: F.exists(r, lambda x: F.trim(x) != ""))  # blank rows are not shown
    shown = F.transform(said, lambda r: F.array_join(F.transform(r, cell), " | "))
    more = F.size(rows) - TABLE_ROWS
    return F.when(more > 0, F.concat(shown, F.array(F.format_string("… %d further row(s) not shown", more)))).otherwise(shown)


def index_rows(rows: Column) -> Column:
    """Lines of rows with two filled cells at least."""
    filled = F.transform(F.slice(rows, 1, TABLE_ROWS), lambda r: F.filter(F.transform(r, lambda x: F.trim(x)), lambda x: x != ""))
    return F.transform(F.filter(filled, lambda r: F.size(r) >= 2), lambda r: F.array_join(r, " | "))


def results_json(paragraphs: DataFrame) -> DataFrame:
    """One JSON result for each file: its patients with their paragraphs in order, and the page count."""
    bundles = paragraphs.groupBy("file_id", "bundle").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_pos", "text"))), lambda x: x["text"]).alias("paragraphs"), F.max("page_end").alias("page_end"))
    files = bundles.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("bundle", "paragraphs"))).alias("patients"), F.max("page_end").alias("page_count"))
    return files.select("file_id", F.to_json(F.struct("patients", "page_count")).alias("result"))


def rtf_escaped(text: Column) -> Column:
    """Text for an RTF file: its own signs escaped, other characters as numbers."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\{}])", r"\\$1")
    def unit(c: Column) -> Column:
        point = F.ascii(c)
        return F.when(point < 128, c).otherwise(F.concat(F.lit("\\u"), F.when(point > 32767, point - 65536).otherwise(point).cast("string"), F.lit("?")))
    return F.when(plain.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(plain, ""), unit), "")).otherwise(plain)


def rtf_documents(paragraphs: DataFrame) -> DataFrame:
    """One RTF document for each file: its paragraphs in order."""
    body = paragraphs.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bundle", "para_pos", rtf_escaped(F.col("text")).alias("t")))), lambda x: x["t"]), "\\par\n").alias("body"))
    return body.select("file_id", F.encode(F.concat(F.lit("{\\rtf1\\ansi\\deff0\n"), "body", F.lit("\\par\n}")), "US-ASCII").alias("rtf"))


def log_positions(lines: DataFrame, *order: str) -> DataFrame:
    """ordinal of each line, from 0, within its log."""
    return lines.withColumn("ordinal", F.row_number().over(Window.partitionBy("log").orderBy(*order)) - 1)
