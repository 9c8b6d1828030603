"""Scrubbing, redaction and small text functions (X01, X04, X05, T01, T02, T11, T12, T19, T25, M06, M07, P17), all of them built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions._let import let

# What counts as personal data, deleted in this order.
PERSONAL = (
    r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
    r"\b\(\d{3}\)\s?\d{3}[-.\s]\d{4}\b",
    r"\b\d{3}[-.\s]\d{2}[-.\s]\d{3,4}\b",
    r"\b[A-Z]\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
    r"\b\d{10}\b",
    r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    r"(?i)\b\d{1,5}\s+[\w.\s-]+(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Boulevard|Blvd\.|Drive|Dr\.|Lane|Ln\.|Court|Ct\.|Crescent|Cres\.|Place|Pl\.)\b",
    r"(?i)\b(?:OHIP|Health\s*Card|MRN|HCN|SIN|Tel(?:ephone)?|Phone|Fax|Email|E-mail|Address)\s*[:#]?\s*[^\s,]+",
)
#: What an address ends with; a text without it has no address, which spares it the search from every number on.
_STREET = r"(?i)(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Boulevard|Blvd\.|Drive|Dr\.|Lane|Ln\.|Court|Ct\.|Crescent|Cres\.|Place|Pl\.)\b"
#: Telephone numbers that the list above lets pass: with a country code or area code in brackets.
PERSONAL_STRICT = (r"(?:\+\d{1,3}\s?)?\(\d{3}\)\s?\d{3}[-.\s]\d{4}\b", *PERSONAL)

# What counts as a secret, replaced in this order.
SECRETS = (
    r"\bsk-(?:proj-|svcacct-|admin-)?[A-Za-z0-9_-]{16,}",
    r"\borg-[A-Za-z0-9]{16,}",
    r"\bAIza[A-Za-z0-9_-]{20,}",
    r"\bsk-ant-[A-Za-z0-9_-]{16,}",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{12,}",
    r"(?i)\b(?:aws_secret_access_key|secret[_-]?access[_-]?key)\s*[=:]\s*\S+",
    r"\bllx-[A-Za-z0-9_-]{16,}",
    r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{16,}=*",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|password)\s*[=:]\s*\S+",
)
URL_CREDENTIALS = r"(?i)\b([a-z][a-z0-9+.-]*://)[^/\s:@]+:[^/\s@]+@"
REDACTED = "[redacted]"

# Words of numbers.
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def _each(text: Column, patterns: Sequence[str], by: str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, by), patterns, text)


def _without_personal(text: Column, patterns: Sequence[str]) -> Column:
    """The same with nothing in their place; the pattern of addresses is tried only where one can end."""
    def one(text: Column, p: str) -> Column:
        if "Street" not in p:
            return F.regexp_replace(text, p, "")
        return let(text, lambda t: F.when(t.rlike(_STREET), F.regexp_replace(t, p, "")).otherwise(t))

    return reduce(one, patterns, text)


def pii_scrub(text: Column, patterns: Sequence[str] = PERSONAL) -> Column:
    """Without personal data; runs of blanks become one, and edges lose separators."""
    tidy = F.regexp_replace(_without_personal(text, patterns), r"\s{2,}", " ")
    return F.call_function("btrim", tidy, F.lit(" ,;:|"))


def redact_secrets(text: Column) -> Column:
    """With secrets replaced; credentials in a URL go, its scheme and host stay; null is blank."""
    return F.regexp_replace(_each(F.coalesce(text, F.lit("")), SECRETS, REDACTED), URL_CREDENTIALS, "$1" + REDACTED.replace("[", "\\[") + "@")


def clean_text(text: Column) -> Column:
    """Trimmed, runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """Words parted by white space."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def normalize_key(text: Column) -> Column:
    """Lower-case letters and digits alone, for comparing titles (T02); Latin accents are dropped."""
    return F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), "[^a-z0-9]", "")


_ACCENTED = "ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿŠšŽžČčŘřŇňĚěŮůŐőŰű"
_BARE = "AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyySsZzCcRrNnEeUuOoUu"


def strip_accents(text: Column) -> Column:
    """Latin letters without their accents (T01); ``fuzzy.strip_accents_exact`` does all of Unicode."""
    return F.translate(text, _ACCENTED, _BARE)


def spell_number(n: Column) -> Column:
    """0 to 9999 in words, larger numbers in digits."""
    ones, tens = F.array(*[F.lit(x) for x in ONES]), F.array(*[F.lit(x) for x in TENS])

    def at(words: Column, k: Column) -> Column:
        return F.get(words, k.cast("int"))

    def below_hundred(k: Column) -> Column:
        ten = at(tens, F.floor(k / 10))
        return F.when(k < 20, at(ones, k)).when(k % 10 == 0, ten).otherwise(F.concat_ws("-", ten, at(ones, k % 10)))

    def below_thousand(k: Column) -> Column:
        head = F.concat(at(ones, F.floor(k / 100)), F.lit(" hundred"))
        return F.when(k < 100, below_hundred(k)).when(k % 100 == 0, head).otherwise(F.concat_ws(" and ", head, below_hundred(k % 100)))

    head = F.concat(below_hundred(F.floor(n / 1000)), F.lit(" thousand"))
    rest = n % 1000
    large = F.when(rest == 0, head).when(rest < 100, F.concat_ws(" and ", head, below_hundred(rest))).otherwise(F.concat_ws(" ", head, below_thousand(rest)))
    return F.when((n < 0) | (n > 9999), n.cast("string")).when(n < 1000, below_thousand(n)).otherwise(large)


def first_image_caption(markdown: Column) -> Column:
    """The text of the first image in markdown, blank if there is none."""
    return F.trim(F.regexp_extract(markdown, r"!\[([^\]]*)\]", 1))


def json_lenient(content: Column, schema: str) -> Column:
    """JSON of this schema from an answer that may wrap it in a code fence or in prose: an object, else an array."""
    tries = [content, F.regexp_extract(content, r"(?is)```(?:json)?\s*(.*?)\s*```", 1), F.regexp_extract(content, r"(?s)(\{.*\})", 1), F.regexp_extract(content, r"(?s)(\[.*\])", 1)]
    ok = [F.when((t != "") & F.try_parse_json(F.when(t != "", t)).isNotNull(), t) for t in tries]
    return F.from_json(F.coalesce(*ok), schema)


def page_label(first: Column, last: Column) -> Column:
    """``3`` or ``3–5``."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("–", first.cast("string"), last.cast("string")))


def format_cost(usd: Column) -> Column:
    """Dollars with four digits after the point, six for very small amounts."""
    return F.when(usd <= 0, F.lit("$0.000000")).when(usd < 1e-4, F.format_string("$%.6f", usd)).otherwise(F.format_string("$%.4f", usd))


def format_tokens(n: Column) -> Column:
    """1.23M, 1.2k or the number."""
    return F.when(n >= 1_000_000, F.format_string("%.2fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fk", n / 1000)).otherwise(n.cast("string"))


def file_kind(name: Column, content_type: Column) -> Column:
    """pdf, image, audio, video, document or download by MIME type, else by extension; the first that fits."""
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    mime = F.lower(F.coalesce(content_type, F.lit("")))
    kinds = (("pdf", mime == "application/pdf", ("pdf",)), ("image", mime.startswith("image/"), ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff")), ("audio", mime.startswith("audio/"), ("mp3", "wav", "m4a", "ogg")), ("video", mime.startswith("video/"), ("mp4", "mov", "webm", "avi")), ("document", mime.contains("word") | mime.contains("rtf"), ("doc", "docx", "rtf", "txt")))
    return F.coalesce(*[F.when(test | ext.isin(*exts), F.lit(kind)) for kind, test, exts in kinds], F.lit("download"))


def export_name(source: Column, patient: Column | None = None) -> Column:
    """The name of a result's file: the patient and the source's stem, with other signs as hyphens."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(source, F.lit("")), r"([^/]*)/*$", 1), r"(?<=[^.])\.[^.]*$", "")
    if patient is not None:
        who = F.trim(F.regexp_replace(F.coalesce(patient, F.lit("")), r"[^\p{L}\p{N} -]", ""))
        stem = F.when(who != "", F.concat(who, F.lit(" - "), stem)).otherwise(stem)
    safe = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N} _-]", "-"), r"^[ _-]+|[ _-]+$", "")
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("extractive-summary")), F.lit(".doc"))
