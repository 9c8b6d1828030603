"""Deterministic lines, labels and names that are shown or filed (T21, T22, T24, T26, T28-T31, P04-P06, X03, X12, D13, M09, W17), all built-in expressions.

Null is blank where a text is expected, unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions.dates import display_date
from pagegraph.functions.names import clean_title, format_author

# Labels of a document without a title, and of its kind.
KIND_LABELS = {"imaging": "imaging report", "pathology": "pathology report", "functional": "functional report", "administrative": "document"}
TYPE_LABELS = ("imaging", "pathology", "functional", "administrative")

# What stands for pages without a summary, and for images without a caption.
UNREADABLE = " could not be read during parsing - review the source page(s) directly."
ADMINISTRATIVE = "administrative content only (cover/consent/billing); nothing clinical to summarize"
BLANK_PAGES = "Blank or near-blank page(s); no content captured."
PARSE_ERROR = "[parse-error"
CAPTION = "Medical image"
CAPTION_MARKS = ("![", "medical image on page")

# Dates that are highlighted in a text.
SHOWN_DATES = r"(?i)\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|(?:Jan|January|Feb|February|Mar|March|Apr|April|May|Jun|June|Jul|July|Aug|August|Sep|Sept|September|Oct|October|Nov|November|Dec|December)(?:\s+\d{1,2}(?:,\s*|\s+)\d{4}|\s+\d{4}))\b"

# Labels of states and stages, names that calls have in the log and what they are shortened to.
STATUS_LABELS = {"completed": "Ready", "failed": "Failed", "cancelled": "Cancelled", "processing": "Processing"}
STAGE_LABELS = {"parse": "Parse", "summarize": "LLM"}
LOG_NAMES = ((r"(?i)^Gemini page parsing batch\s+", "Page batch "), (r"(?i)^OpenAI patient bundle extraction\s+", "Bundle "), (r"(?i)^OpenAI patient bundle merge\s+", "Bundle merge "))

# Content types by extension; anything else is a stream of bytes.
CONTENT_TYPES = {
    ".pdf": "application/pdf", ".doc": "application/msword", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".rtf": "application/rtf",
    ".txt": "text/plain", ".csv": "text/csv", ".html": "text/html", ".json": "application/json", ".xml": "text/xml", ".zip": "application/zip", ".png": "image/png", ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".tiff": "image/tiff", ".webp": "image/webp", ".mp3": "audio/mpeg", ".wav": "audio/x-wav", ".mp4": "video/mp4", ".mov": "video/quicktime", ".avi": "video/x-msvideo",
}
BYTES = "application/octet-stream"
LONGEST_DIAGNOSIS, COLOURS = 120, 8


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def strip(value: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(_text(value), r"^\s+|\s+$", "")


def _mapped(value: Column, labels: dict[str, str], other: Column) -> Column:
    out = other
    for key, label in labels.items():
        out = F.when(value == key, F.lit(label)).otherwise(out)
    return out


def _capital(value: Column, upper: bool = True) -> Column:
    return F.concat((F.upper if upper else F.lower)(F.substring(value, 1, 1)), F.substring(value, 2, 1 << 30))


def _spaced(*parts: Column) -> Column:
    """The parts that are not blank, with a blank between."""
    return F.array_join(F.filter(F.array(*[_text(p) for p in parts]), lambda p: p != ""), " ")


def _ended(value: Column) -> Column:
    """With one full stop at the end."""
    return F.concat(F.regexp_replace(value, r"\.+$", ""), F.lit("."))


def kind_label(bucket: Column) -> Column:
    """What a document without a title is called."""
    return _mapped(bucket, KIND_LABELS, F.lit("clinical note"))


def type_label(bucket: Column) -> Column:
    """The type of a document, clinical if none of the named ones."""
    return F.when(bucket.isin(*TYPE_LABELS), bucket).otherwise("clinical")


def registered_type(rule_type: Column, custom_type: Column, bucket: Column) -> Column:
    """The type that a document was registered as: its rule's, else its own, else its bucket."""
    return F.coalesce(rule_type, F.nullif(custom_type, F.lit("")), bucket)


def placeholder_text(n_pages: Column, unreadable: Column, administrative: Column, date: Column, title: Column) -> Column:
    """Why pages have no summary (T22); unreadable, administrative: whether any of the pages is."""
    detail = _spaced(display_date(date), clean_title(title))
    plain = F.when(detail != "", F.concat(detail, F.lit(f" - {ADMINISTRATIVE}."))).otherwise(F.lit(ADMINISTRATIVE[0].upper() + ADMINISTRATIVE[1:] + "."))
    return F.when(unreadable, F.concat(F.when(n_pages > 1, "Pages").otherwise("Page"), F.lit(UNREADABLE))).when(administrative, plain).otherwise(BLANK_PAGES)


def is_unreadable(excerpt: Column) -> Column:
    """A page that could not be read."""
    return _text(excerpt).startswith(PARSE_ERROR)


def lab_line(bucket: Column, date: Column, title: Column) -> Column:
    """The line that stands for a document that is listed, not summarised."""
    label = F.coalesce(F.nullif(clean_title(title), F.lit("")), F.when(bucket == "pathology", "lab report").otherwise(kind_label(bucket)))
    shown = _text(display_date(date))
    return F.when(shown != "", F.concat(shown, F.lit(" "), label, F.lit("."))).otherwise(F.concat(_capital(label), F.lit(".")))


def is_caption(text: Column) -> Column:
    """An image's caption rather than a report's text."""
    low = F.lower(strip(text))
    return low.startswith(CAPTION_MARKS[0]) | low.startswith(CAPTION_MARKS[1])


def image_only(texts: Column) -> Column:
    """Of a document's evidence, at least one text is not blank, and all such are captions."""
    said = F.filter(texts, lambda t: strip(t) != "")
    return F.coalesce((F.size(said) > 0) & F.forall(said, is_caption), F.lit(False))


def image_line(texts: Column, date: Column) -> Column:
    """The line that stands for an image: its date and the first caption."""
    first = strip(F.get(F.filter(texts, lambda t: strip(t) != ""), F.lit(0)))
    inner = F.when(first.startswith("![") & first.endswith("]"), strip(F.regexp_replace(first, r"(?s)^!\[(.*)\]$", "$1"))).otherwise(first)
    caption = F.coalesce(F.nullif(inner, F.lit("")), F.lit(CAPTION))
    shown = _text(display_date(date))
    return _ended(F.when(shown != "", F.concat(shown, F.lit(", "), _capital(caption, upper=False))).otherwise(caption))


def opener(own_date: Column, date: Column, title: Column, bucket: Column, author: Column, is_doctor: Column, credentials: Column) -> Column:
    """Date, title and author, with which a paragraph begins."""
    shown = F.coalesce(F.nullif(display_date(own_date), F.lit("")), display_date(date))
    who = _text(format_author(author, is_doctor, credentials))
    named = F.coalesce(F.nullif(clean_title(title), F.lit("")), kind_label(bucket))
    return _ended(_spaced(shown, named, F.when(who != "", F.concat(F.lit("by "), who))))


def fallback_paragraph(opening: Column, texts: Column) -> Column:
    """The opening and every different text of the evidence, null if there is none."""
    tidy = F.filter(F.transform(texts, lambda t: F.regexp_replace(strip(t), r"[. ]+$", "")), lambda t: t != "")
    low = F.transform(tidy, lambda t: F.lower(t))
    first = F.filter(tidy, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)
    return F.when(F.size(first) > 0, F.concat(opening, F.lit(" "), F.array_join(first, ". "), F.lit(".")))


def stub_line(opening: Column, first: Column, last: Column) -> Column:
    """The opening and the pages, for what has no text at all."""
    pages = F.when(first == last, F.concat(F.lit("page "), first.cast("string"))).otherwise(F.concat(F.lit("pages "), first.cast("string"), F.lit("-"), last.cast("string")))
    return F.concat(opening, F.lit(" ("), pages, F.lit(")."))


def scrub_opinion(text: Column) -> Column:
    """Without marks of markdown; words stay."""
    bare = F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    bare = F.regexp_replace(bare, r"(?md)^[*\-#>]+\s*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.when(text.isNotNull(), strip(bare))


def file_name(name: Column, fallback: str = "upload") -> Column:
    """The last part of a path, the fallback if there is none."""
    last = F.trim(F.regexp_extract(F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback)), r"([^/]*)/*$", 1))
    return F.coalesce(F.nullif(last, F.lit("")), F.lit(fallback))


def folder_name(name: Column) -> Column:
    """A folder's name with blanks for slashes; null where nothing is left."""
    return F.nullif(strip(F.translate(_text(name), "/\\", "  ")), F.lit(""))


def extension(name: Column) -> Column:
    """The lower-case ending with its dot, or null."""
    return F.nullif(F.lower(F.regexp_extract(_text(name), r"(?s)[^/.][^/]*?(\.[^./]+)$", 1)), F.lit(""))


def content_type(name: Column, given: Column) -> Column:
    """The given type unless it says nothing, else that of the ending."""
    low = F.lower(F.trim(_text(given)))
    return F.when((low != "") & (low != BYTES), low).otherwise(_mapped(extension(name), CONTENT_TYPES, F.lit(BYTES)))


def shown_dates(text: Column) -> Column:
    """The dates that are highlighted in a text, in order."""
    return F.regexp_extract_all(_text(text), F.lit(SHOWN_DATES), F.lit(0))


def diagnosis_display(text: Column) -> Column:
    """The first statement of a diagnosis, without its label, of limited length; N/A if it says so or says nothing."""
    flat = strip(F.regexp_replace(F.translate(text, "|", " "), r"\s+", " "))
    pieces = F.filter(F.transform(F.split(flat, "[.;]"), strip), lambda p: p != "")
    bare = F.coalesce(F.get(pieces, F.lit(0)), flat)
    bare = strip(F.regexp_replace(F.regexp_replace(bare, r"(?i)^diagnosis\s*[:/-]?\s*", ""), r"(?i)^main diagnosis\s*[:/-]?\s*", ""))
    short = F.concat(F.regexp_replace(F.left(bare, F.lit(LONGEST_DIAGNOSIS - 3)), r"\s+$", ""), F.lit("..."))
    said = F.when(flat.rlike(r"(?i)\bN/A\b") | (bare == ""), "N/A").when(F.length(bare) <= LONGEST_DIAGNOSIS, bare).otherwise(short)
    return F.when(text == "", text).when(flat != "", said)


def log_label(task: Column, process: Column, direction: Column, ordinal: Column) -> Column:
    """What an entry of the log is called (T30); ordinal from 0."""
    return F.array_join(F.filter(F.array(F.coalesce(task, F.concat(F.lit("Entry "), (ordinal + 1).cast("string"))), _text(process), _text(direction)), lambda p: p != ""), " | ")


def short_label(label: Column, ordinal: Column) -> Column:
    """The same, shortened."""
    out = label
    for pattern, by in LOG_NAMES:
        out = F.regexp_replace(out, pattern, by)
    return F.when(strip(label) == "", F.concat(F.lit("LLM call "), (ordinal + 1).cast("string"))).otherwise(F.regexp_replace(out, r"\s+", " "))


def status_label(status: Column) -> Column:
    """A job's state in words."""
    return _mapped(status, STATUS_LABELS, F.lit("Queued"))


def stage_label(stage: Column) -> Column:
    """A stage in words, itself if it has none."""
    return _mapped(stage, STAGE_LABELS, stage)


def is_first_hand(provenance: Column) -> Column:
    """The document states the finding itself (P04); no provenance is primary."""
    return F.coalesce(provenance, F.lit("primary")) == "primary"


def is_bare_image(kind: Column, title: Column, author: Column, date: Column) -> Column:
    """An image without a header of its own."""
    return (kind == "imaging") & (_text(title) == "") & (_text(author) == "") & (_text(date) == "")


def colour(document_number: Column) -> Column:
    """Which of the colours a document has."""
    return F.pmod(F.greatest(document_number, F.lit(1)) - 1, F.lit(COLOURS)).cast("int")


def model_text(raw: Column) -> Column:
    """The text of a model's answer in JSON: text, or content, or the text parts of content on lines of their own.

    A part that is an object counts only if its type is text; null if there is neither text nor content.
    """
    content = F.get_json_object(raw, "$.content")
    parts = F.filter(F.from_json(content, "array<string>"), lambda p: ~p.startswith("{") | (F.get_json_object(p, "$.type") == "text"))
    joined = F.array_join(F.transform(parts, lambda p: F.when(p.startswith("{"), _text(F.get_json_object(p, "$.text"))).otherwise(p)), "\n")
    return F.coalesce(F.get_json_object(raw, "$.text"), F.when(content.startswith("["), joined).otherwise(content))


def distinct_names(names: Column) -> Column:
    """Names with single blanks, each once, none blank."""
    return F.array_distinct(F.filter(F.transform(names, lambda n: strip(F.regexp_replace(_text(n), r"\s+", " "))), lambda n: n != ""))


def iso_utc(ts: Column) -> Column:
    """A time to the second, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def made_id(prefix: str, key: Column) -> Column:
    """An identifier that depends on the key alone, so that a task that runs again makes the same one."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(key.cast("string"), 256), 1, 12))
