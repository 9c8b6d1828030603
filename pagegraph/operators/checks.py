"""What a whole file says about its documents: contradictions, duplicates, absences, odd dates, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.functions.dates import canonical_date, is_ambiguous, leading_date, votes_day_first, votes_month_first
from pagegraph.operators._distinct import per_value

# Wording that finds nothing, wording that finds something, negated findings, and regions of the body.
NEGATIVE = r"(?i)\b(?:normal|unremarkable|no acute (?:abnormality|finding|process)|within normal limits|negative study)\b"
POSITIVE = r"(?i)\b(?:opacification|fracture|lesion|mass|effusion|consolidation|haemorrhage|hemorrhage|infarct|stenosis|herniation|compression|lucency|nodule|tumou?r|abnormal(?:ity|ities)?|deformity|displacement|oedema|edema)\b"
NEGATED = r"(?i)\b(?:no|without|free of|negative for)\s+(?:\w+\s+){0,3}?(?:abnormalit(?:y|ies)|acute (?:abnormality|finding|process|intrathoracic process)|aggressive|consolidation|effusion|fracture|haemorrhage|hemorrhage|infarct|lesions?|mass(?: effect)?|nodules?|oedema|edema)"
REGIONS = ("sinus", "chest", "rib", "brain", "head", "skull", "spine", "abdomen", "pelvis", "knee", "shoulder", "hip", "ankle", "wrist", "hand", "foot", "neck")

# What each gap costs a document's score, and the score below which it is looked at.
PENALTIES = {"missing_date": 0.35, "ambiguous_date": 0.20, "missing_author": 0.25, "no_evidence": 0.30, "thin_evidence": 0.15, "missing_title": 0.10, "broken_pagination": 0.15, "second_hand": 0.20}
REVIEW_BELOW = 0.65
YEARS_OFF, LEAST_DATED = 25, 3
LEAST_ON_PAGE, MOST_ROW_EVIDENCE, RICHER_BY = 3, 2, 3


def regions(text: Column) -> Column:
    """Names of regions that the text contains, also inside of words."""
    return F.filter(F.array(*[F.lit(r) for r in REGIONS]), lambda r: F.contains(F.lower(text), r))


def asserts_positive(text: Column) -> Column:
    """Something was found."""
    return F.regexp_replace(text, NEGATED, " ").rlike(POSITIVE)


def asserts_negative(text: Column) -> Column:
    """Nothing was found."""
    return text.rlike(NEGATIVE) & ~asserts_positive(text)


def contradictions(paragraphs: DataFrame) -> DataFrame:
    """Pairs of imaging paragraphs with one date and a region in common, of which one finds nothing and one something.

    The patterns are evaluated once for each paragraph, before it becomes a row for each region. The join is on file,
    date and region, so only paragraphs that can contradict meet.
    """
    told = paragraphs.select("file_id", "para_pos", leading_date(F.col("text")).alias("iso"), regions(F.col("text")).alias("regions"), F.col("text").rlike(NEGATIVE).alias("denies"), asserts_positive(F.col("text")).alias("something"))
    told = told.where("iso is not null and (denies or something)").select("file_id", "para_pos", "iso", "denies", "something", F.explode("regions").alias("region"))
    nothing = told.where("denies and not something").select("file_id", "iso", "region", F.col("para_pos").alias("a"))
    something = told.where("something").select("file_id", "iso", "region", F.col("para_pos").alias("b"))
    return nothing.join(something, ["file_id", "iso", "region"]).select("file_id", "iso", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second")).distinct()


def duplicate_studies(documents: DataFrame) -> DataFrame:
    """Each later document of the same date, bucket and author, with the first one."""
    key = Window.partitionBy("file_id", "iso", "bucket", "_author").orderBy("doc_pos")
    keyed = documents.withColumn("_author", F.lower(F.trim("author"))).where("iso is not null and _author <> ''")
    first = F.first("doc_pos").over(key.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return keyed.withColumns({"first_pos": first, "_n": F.row_number().over(key)}).where("_n > 1").select("file_id", "doc_pos", "first_pos", "iso", "bucket")


def absent_references(references: DataFrame, documents: DataFrame, most: int = 3) -> DataFrame:
    """Dates that a document points to and no document of its file has; the first few of each document."""
    lost = references.where("iso is not null").select("file_id", "doc_pos", "iso").distinct().join(documents.select("file_id", "iso").distinct(), ["file_id", "iso"], "left_anti")
    w = Window.partitionBy("file_id", "doc_pos").orderBy("iso")
    return lost.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).groupBy("file_id", "doc_pos").agg(F.array_sort(F.collect_list("iso")).alias("dates"))


def listing_rows(documents: DataFrame) -> DataFrame:
    """Documents that are rows of a listing: thin, on a page with others, and a fuller one of their date is elsewhere.

    documents: file_id, doc_pos, sole_page (null if on several), iso, n_evidence.
    """
    page = Window.partitionBy("file_id", "sole_page")
    rich = F.max_by(F.struct("doc_pos", "iso"), F.struct("n_evidence", -F.col("doc_pos"))).over(page)
    thin = documents.where("sole_page is not null").withColumns({"_n": F.count("*").over(page), "_rich": rich})
    thin = thin.where((F.col("_n") >= LEAST_ON_PAGE) & (F.col("doc_pos") != F.col("_rich.doc_pos")) & (F.col("n_evidence") <= MOST_ROW_EVIDENCE) & F.col("iso").isNotNull() & ~F.col("iso").eqNullSafe(F.col("_rich.iso")))
    d, o = thin.alias("d"), documents.alias("o")
    fuller = (F.col("d.file_id") == F.col("o.file_id")) & (F.col("d.iso") == F.col("o.iso")) & (F.col("o.n_evidence") >= F.col("d.n_evidence") + RICHER_BY) & ~F.col("o.sole_page").eqNullSafe(F.col("d.sole_page"))
    return d.join(o, fuller, "left_semi").select("file_id", "doc_pos", "sole_page", "iso")


def temporal_outliers(documents: DataFrame, review_date: Column) -> DataFrame:
    """Documents dated after the review, or far from the upper median year of three dated ones at least."""
    year = F.substring("iso", 1, 4).cast("int")
    dated = documents.where("iso is not null").withColumn("year", year)
    middle = dated.groupBy("file_id").agg(F.sort_array(F.collect_list("year")).alias("_years")).where(F.size("_years") >= LEAST_DATED).select("file_id", F.element_at("_years", F.floor(F.size("_years") / 2).cast("int") + 1).alias("median_year"))
    kind = F.when(F.col("iso") > review_date, "date_after_review").when(F.abs(F.col("year") - F.col("median_year")) > YEARS_OFF, "date_far_from_the_file")
    return dated.join(middle, "file_id").withColumn("kind", kind).where("kind is not null").select("file_id", "doc_pos", "kind", "median_year")


def unattributed(documents: DataFrame) -> DataFrame:
    """One row for each file with clinical or imaging documents without an author."""
    open_docs = documents.where(F.col("include") & F.col("bucket").isin("clinical", "imaging") & (F.coalesce(F.trim("author"), F.lit("")) == "") & ~F.coalesce("claimant_authored", F.lit(False)))
    return open_docs.groupBy("file_id").agg(F.count("*").alias("n"), F.min("doc_pos").alias("first_pos"))


def all_warnings(*checks: tuple[str, DataFrame]) -> DataFrame:
    """kind and file of every finding, with the order of the checks."""
    parts = [df.select(F.lit(k).alias("check_ord"), F.lit(name).alias("kind"), "file_id") for k, (name, df) in enumerate(checks)]
    return reduce(DataFrame.unionByName, parts)


def document_dates(documents: DataFrame) -> DataFrame:
    """The dates of each file's documents that can be read, in order (D11); documents: file_id, doc_pos, date."""
    dated = per_value(documents, ["date"], iso=canonical_date(F.col("date"))).where("iso is not null")
    listed = F.array_sort(F.collect_list(F.struct("doc_pos", "iso")))
    return dated.groupBy("file_id").agg(F.transform(listed, lambda x: x["iso"]).alias("dates"))


def date_convention(samples: DataFrame) -> DataFrame:
    """day_first of each file, null where its dates do not settle it, and the votes."""
    votes = samples.groupBy("file_id").agg(F.count_if(votes_day_first(F.col("raw"))).alias("day_votes"), F.count_if(votes_month_first(F.col("raw"))).alias("month_votes"))
    settled = F.when((F.col("day_votes") > 0) & (F.col("month_votes") == 0), True).when((F.col("month_votes") > 0) & (F.col("day_votes") == 0), False)
    return votes.withColumn("day_first", settled)


def quality(documents: DataFrame) -> DataFrame:
    """score, reasons and needs_review of each document.

    documents: date, author, title, claimant_authored, n_evidence, n_first_hand, n_pages, convention_resolved, broken.
    """
    def blank(c: str) -> Column:
        return F.coalesce(F.trim(c), F.lit("")) == ""

    documents = per_value(documents, ["date"], _iso=canonical_date(F.col("date")), _open=is_ambiguous(F.col("date")))
    iso = F.col("_iso")
    gaps = {
        "missing_date": iso.isNull(),
        "ambiguous_date": iso.isNotNull() & F.col("_open") & ~F.col("convention_resolved"),
        "missing_author": blank("author") & ~F.coalesce("claimant_authored", F.lit(False)),
        "no_evidence": F.col("n_evidence") == 0,
        "thin_evidence": (F.col("n_evidence") > 0) & (F.col("n_evidence") < F.col("n_pages")),
        "second_hand": (F.col("n_evidence") >= F.col("n_pages")) & (F.col("n_evidence") > 0) & (F.col("n_first_hand") == 0),
        "missing_title": blank("title"),
        "broken_pagination": F.coalesce("broken", F.lit(False)),
    }
    lost = reduce(lambda a, b: a + b, [F.when(test, int(round(PENALTIES[name] * 100))).otherwise(0) for name, test in gaps.items()])
    score = F.greatest(F.lit(0), 100 - lost) / 100
    reasons = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in gaps.items()]), lambda r: r.isNotNull())
    return documents.withColumns({"score": score, "reasons": reasons, "needs_review": score < REVIEW_BELOW}).drop("_iso", "_open")


def broken_pagination(entries: DataFrame) -> DataFrame:
    """broken for each segment whose printed pages are not 1 to their total, once each."""
    usable = F.when((F.col("marker_index") > 0) & (F.col("marker_index") <= F.col("marker_total")) & (F.col("marker_total") > 1), F.struct("marker_index", "marker_total"))
    grouped = entries.groupBy("file_id", "segment").agg(F.count(usable).alias("n"), F.count_distinct(usable["marker_index"]).alias("d"), F.min(usable["marker_total"]).alias("lo"), F.max(usable["marker_total"]).alias("hi"))
    return grouped.select("file_id", "segment", ((F.col("n") > 0) & ((F.col("lo") != F.col("hi")) | (F.col("n") != F.col("hi")) | (F.col("d") != F.col("n")))).alias("broken"))
