"""From entries to documents: segmentation, sub-sections, and what a document takes from its entries.

``segment_dated`` is the exact operator. What it carries from entry to entry belongs to the run that it helps to
delimit, and its comparisons are fuzzy, so it folds over the files in Python. ``segment_islands`` is a
window form with comparisons by equality, for streams of entries that only date, type or person divide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions import fuzzy
from pagegraph.functions.dates import first_of
from pagegraph.functions.names import claimant_authored, name_key, patient_key
from pagegraph.functions.text import normalize_key
from pagegraph.operators._distinct import per_value
from pagegraph.operators._fold import per_file
from pagegraph.operators.entries import BARE_KINDS, by_file, carry_patient, repair_printed_runs

UNKNOWN = "unknown"
#: Kinds that stand in for an unknown bucket.
KIND_BUCKETS = ("imaging", "pathology", "functional", "clinical")


@dataclass
class _Run:
    """The values that a run has shown last, and the page and marker of its last entry."""

    values: dict[str, str] = field(default_factory=dict)
    page: int | None = None

    def show(self, entry: dict, reset: bool) -> None:
        if reset:
            self.values = {}
        self.values |= {k: entry[k] for k in ("_date", "_title", "_author", "_patient") if entry[k]}
        if entry["bucket"] and entry["bucket"] != UNKNOWN or reset:
            self.values["bucket"] = entry["bucket"] or UNKNOWN
        self.page = entry["page_number"]


def _begins(entry: dict, run: _Run, marker: tuple | None) -> bool:
    """Whether an entry begins a new document after this run."""
    seen = run.values
    both = {k: bool(entry[k] and seen.get(k)) for k in ("_date", "_title", "_author", "_patient")}
    index, total = entry["marker_index"] or 0, entry["marker_total"] or 0
    usable = 0 < index <= total and total > 1
    if usable and index == 1:
        return True
    if usable and marker == (index - 1, total):
        return False
    if both["_patient"] and entry["_patient"] != seen["_patient"]:
        return True
    if both["_date"] and entry["_date"] != seen["_date"]:
        return True
    same_page = entry["page_number"] == run.page and bool(entry["starts_new"])
    if not entry["_date"]:
        return same_page
    buckets = {entry["bucket"] or UNKNOWN, seen.get("bucket") or UNKNOWN}
    fits = len(buckets) == 1 or UNKNOWN in buckets
    if both["_date"] and fits:
        return False  # the same dated source goes on
    other = not fits or (both["_title"] and not fuzzy.titles_alike(entry["_title"], seen["_title"])) or (both["_author"] and not fuzzy.keys_equivalent(entry["_author"], seen["_author"]))
    return same_page or (bool(entry["starts_new"]) and other)


def _numbers(entries: list[dict]) -> list[int | None]:
    """The segment of each entry of a file."""
    out, run, n, marker = [], None, 0, None
    for entry in entries:
        index, total = entry["marker_index"] or 0, entry["marker_total"] or 0
        if not entry["include"] and entry["kind"] in ("empty", "admin"):
            run = None
            out.append(None)
        else:
            new = run is None or _begins(entry, run, marker)
            if new:
                run, n = _Run(), n + 1
            run.show(entry, new)
            out.append(n)
        marker = (index, total) if 0 < index <= total and total > 1 else None
    return out


def segment_dated(entries: DataFrame) -> DataFrame:
    """entries, repaired and with patients carried forward, with segment, from 1 in each file, null for what is left out."""
    ready = carry_patient(repair_printed_runs(entries).drop("run_start"))
    keys = {"_date": normalize_key(F.col("date")), "_title": normalize_key(F.col("title")), "_author": name_key(F.col("author"))}
    keyed = per_value(ready.withColumns(keys), ["patient_name", "patient_dob"], _patient=patient_key(F.col("patient_name"), F.col("patient_dob")))
    needed = ["page_number", "marker_index", "marker_total", "include", "kind", "starts_new", "bucket", *keys, "_patient"]
    return per_file(keyed, "entry_seq", needed, "segment", "integer", _numbers).drop(*keys, "_patient")


def segment_islands(entries: DataFrame, *changes: Column) -> DataFrame:
    """segment, from 1: a new one wherever one of the values differs from the entry before."""
    w = by_file()
    begins = F.lag("entry_seq").over(w).isNull()
    for value in changes:
        begins = begins | ~value.eqNullSafe(F.lag(value).over(w))
    return entries.withColumn("segment", F.sum(begins.cast("int")).over(w).cast("int"))


def _earliest(value: Column, when: Column | None = None) -> Column:
    """The value of the first entry that has one."""
    ok = value.isNotNull() if when is None else when
    return F.min_by(F.when(ok, value), F.when(ok, F.col("entry_seq")))


def segment_documents(entries: DataFrame) -> DataFrame:
    """One row for each segment: first values, span, and whether it belongs in the output."""
    filled = {c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in ("title", "date", "author", "custom_type")}
    known = F.when(F.col("bucket") != UNKNOWN, F.col("bucket"))
    kind = F.when(F.col("kind").isin(*KIND_BUCKETS), F.col("kind"))
    person = F.when(F.col("patient_name").isNotNull() | F.col("patient_dob").isNotNull(), F.struct("patient_name", "patient_dob"))
    docs = entries.where("segment is not null").groupBy("file_id", "segment").agg(
        *[_earliest(v).alias(c) for c, v in filled.items()],
        F.coalesce(_earliest(known), _earliest(kind), F.lit(UNKNOWN)).alias("bucket"),
        _earliest(person).alias("_person"),
        F.min_by("page_number", "entry_seq").alias("page_start"), F.max_by("page_number", "entry_seq").alias("page_end"),
        F.count("*").alias("n_entries"), F.sum("n_evidence").alias("n_evidence"),
        (F.max("include") & (F.max("n_evidence") > 0) & F.max(~F.col("kind").isin(*BARE_KINDS))).alias("include"),
    )
    docs = docs.withColumns({"patient_name": F.col("_person.patient_name"), "patient_dob": F.col("_person.patient_dob")}).drop("_person")
    own = F.coalesce(claimant_authored(F.col("author"), F.col("patient_name")), F.lit(False))
    docs = docs.withColumns({"claimant_authored": own, "author": F.when(~own, F.col("author"))})
    docs = per_value(docs, ["patient_name", "patient_dob"], patient_key=patient_key(F.col("patient_name"), F.col("patient_dob")))
    return docs.withColumn("doc_id", F.format_string("doc-%d-%d", "segment", "page_start"))


def subsections(entries: DataFrame) -> DataFrame:
    """sub, from 0 within a document (file_id, segment): a new one where date or author change, compared by equality.

    Values are carried over entries without any. Entries without evidence of their own, or with signatures only, join
    what is before them (W09).
    """
    w = Window.partitionBy("file_id", "segment").orderBy("entry_seq")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    quiet = F.col("kind").isin("empty", "signature_only")
    date, author = F.when(~quiet, F.nullif(normalize_key(F.col("date")), F.lit(""))), F.when(~quiet, F.nullif(name_key(F.col("author")), F.lit("")))
    begins = F.coalesce(date != F.last(date, True).over(past), F.lit(False)) | F.coalesce(author != F.last(author, True).over(past), F.lit(False))
    return entries.where("segment is not null").withColumn("sub", F.sum(begins.cast("int")).over(w).cast("int"))


def absorb_fragments(entries: DataFrame, run: str) -> DataFrame:
    """``run``, renumbered from 0: runs of one entry without evidence or with only signatures join the one before."""
    of_run = Window.partitionBy("file_id", run)
    alone = (F.count("*").over(of_run) == 1) & ((F.col("kind") == "signature_only") | (F.col("n_evidence") == 0))
    first = F.col("entry_seq") == F.min("entry_seq").over(of_run)
    marked = entries.withColumn("_opens", first & ~(alone & (F.min(run).over(Window.partitionBy("file_id")) != F.col(run))))
    return marked.withColumn(run, (F.sum(F.col("_opens").cast("int")).over(by_file()) - 1).cast("int")).drop("_opens")


def group_by_patient(documents: DataFrame) -> DataFrame:
    """One row for each patient of a file, in order of appearance; documents without a key stand alone."""
    key = F.when(F.coalesce("patient_key", F.lit("")) == "", F.concat(F.lit("#"), F.col("segment"))).otherwise(F.col("patient_key"))
    grouped = documents.withColumn("key", key).groupBy("file_id", "key").agg(
        F.min("segment").alias("first_segment"), F.min_by("patient_name", F.when(F.col("patient_name").isNotNull(), F.col("segment"))).alias("name"),
        F.count("*").alias("n_documents"), F.min(F.nullif("page_start", F.lit(0))).alias("page_start"), F.max("page_end").alias("page_end"))
    return grouped.withColumn("bundle", F.row_number().over(Window.partitionBy("file_id").orderBy("first_segment")))


def evidence_signature(texts: Column) -> Column:
    """A document's evidence, comparable whatever its order."""
    return F.array_join(F.array_sort(F.transform(texts, normalize_key)), "|")


def first_label(*values: Column) -> Column:
    """The first that says anything."""
    return first_of(*values)


def refreshed_documents(documents: DataFrame, entries: DataFrame) -> DataFrame:
    """documents with first title, date, type, bucket, author and recipient taken anew from the entries they have now.

    Where the entries have none, what the document had stays. Both have file_id and document, its number.
    """
    names = ("title", "date", "custom_type", "author", "recipient")
    found = {c: _earliest(F.when(F.col(c) != "", F.col(c))) for c in names}
    found["bucket"] = _earliest(F.when(F.col("bucket") != UNKNOWN, F.col("bucket")))
    new = entries.where("document is not null").groupBy("file_id", "document").agg(*[v.alias(f"_{c}") for c, v in found.items()])
    joined = documents.join(new, ["file_id", "document"], "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in found}).drop(*[f"_{c}" for c in found])


def subsection_rows(entries: DataFrame) -> DataFrame:
    """One row for each sub-section (file_id, segment, sub): its identifier, span, first date and author, first known bucket."""
    named = {c: _earliest(F.when(F.col(c) != "", F.col(c))).alias(c) for c in ("date", "author")}
    rows = entries.groupBy("file_id", "segment", "sub").agg(*named.values(), F.coalesce(_earliest(F.when(F.col("bucket") != UNKNOWN, F.col("bucket"))), F.lit(UNKNOWN)).alias("bucket"), F.min_by("page_number", "entry_seq").alias("page_start"), F.max_by("page_number", "entry_seq").alias("page_end"), F.count("*").alias("n_entries"))
    return rows.withColumn("sub_id", F.format_string("doc-%d::%d", "segment", "sub"))


def _sub_numbers(rows: list[dict]) -> list[int]:
    """The sub-section of each entry of a file; entries come document by document."""
    out, n, document, date, author = [], 0, None, None, None
    for row in rows:
        if row["segment"] != document:
            document, n, date, author = row["segment"], 0, None, None
        if row["kind"] not in ("empty", "signature_only"):
            parted = bool(row["_date"] and date and row["_date"] != date) or bool(row["_author"] and author and not fuzzy.keys_equivalent(row["_author"], author))
            if parted:
                n, date, author = n + 1, None, None
            date, author = row["_date"] or date, row["_author"] or author
        out.append(n)
    return out


def subsections_by_likeness(entries: DataFrame) -> DataFrame:
    """sub, from 0 within a document, as ``subsections`` has it, but authors part only where their names are not alike."""
    keys = {"_date": F.nullif(normalize_key(F.col("date")), F.lit("")), "_author": F.nullif(name_key(F.col("author")), F.lit("")), "_at": F.struct("segment", "entry_seq")}
    own = entries.where("segment is not null").withColumns(keys)
    return per_file(own, "_at", ["segment", "kind", "_date", "_author"], "sub", "integer", _sub_numbers).drop(*keys)


def page_markdown(entries: DataFrame, keys: list[str], order: str = "page_number") -> DataFrame:
    """The markdown of each document's pages, in order, without blank ones."""
    tidy = F.nullif(F.trim(F.coalesce("markdown", F.lit(""))), F.lit(""))
    parts = F.array_sort(F.collect_list(F.when(tidy.isNotNull(), F.struct(F.col(order).alias("at"), tidy.alias("m")))))
    return entries.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["m"]), "\n\n").alias("markdown"))


def all_evidence(entries: DataFrame, keys: list[str], order: str = "page_number") -> DataFrame:
    """The evidence of each document, page by page."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce("evidence", F.array().cast(entries.schema["evidence"].dataType)).alias("e"))))
    return entries.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p["e"])).alias("evidence"))


def flattened_entries(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs of older results with each of several nested entries as one of its own, numbered anew.

    paragraphs: patient, para_pos, text, page_start, page_end, document_id, document_type, document_number, is_placeholder,
    subs (text, page_start, page_end). A patient without a paragraph of several entries stays as it is.
    """
    nested = F.max(F.size("subs") > 1).over(Window.partitionBy("patient"))
    marked = paragraphs.withColumns({"_nested": nested, "_many": F.size("subs") > 1})
    own = F.array(F.struct("text", "page_start", "page_end"))
    rows = marked.select("patient", "para_pos", "document_id", "document_type", "document_number", "is_placeholder", "_nested", "_many", F.posexplode(F.when(F.col("_nested") & F.col("_many"), F.col("subs")).otherwise(own)).alias("sub_pos", "s"))
    counts = F.when(F.col("_many"), 1).otherwise((~F.coalesce("is_placeholder", F.lit(False)) & (F.coalesce("document_number", F.lit(0)) != 0)).cast("int"))
    order = Window.partitionBy("patient").orderBy("para_pos", "sub_pos")
    running = F.sum(counts).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    number = F.when(F.col("_nested") & (counts == 1), running).otherwise(F.col("document_number"))
    return rows.select("patient", "para_pos", "sub_pos", "document_id", "document_type", "s.text", "s.page_start", "s.page_end", number.cast("int").alias("document_number"), (F.coalesce("is_placeholder", F.lit(False)) & ~(F.col("_nested") & F.col("_many"))).alias("is_placeholder"))
