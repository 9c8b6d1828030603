"""People's names (T03, T08, T13-T18, A08, A09, P09), by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions._let import let
from pagegraph.functions.dates import canonical_date
from pagegraph.functions.text import normalize_key, strip_accents

# What marks a doctor, words that are not part of a name, particles that belong to a surname, salutations.
CREDENTIALS = ("md", "do", "frcpc", "frcsc", "frcp", "frcs", "facp", "phd", "dds", "dpm", "mbbs", "mbchb", "md.")
NOT_NAMES = ("dr", "dr.", "doctor", "mr", "mr.", "mrs", "mrs.", "ms", "ms.", "miss", "the", "patient", "claimant", "from", "to", "attn", "attention", "by")
PARTICLES = ("du", "de", "da", "di", "del", "della", "dei", "do", "dos", "das", "la", "le", "van", "von", "der", "den", "ter", "ten", "bin", "al", "el")
SALUTATIONS = ("mr", "mrs", "ms", "miss", "dr", "md")
TITLE_NOISE = r"(?i)[\s,;:\-]+(?:Dr|Dr\.|Doctor|MD|RN|To|From|By|Re|Attn|Attention)\.?$"
LEADING_DATE = r"(?i)^\s*(?:\d{1,2}[-/.\s]?[A-Za-z]{3,9}[-/.\s]?\d{2,4}|[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})\s*[-:,]?\s+"


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def name_key(name: Column) -> Column:
    """Sorted, bare tokens joined by | (T03): equal for the same person in any order and spelling of title."""
    tokens = F.transform(_split(F.translate(F.lower(strip_accents(F.coalesce(name, F.lit("")))), ",.;:-", "     ")), lambda t: F.regexp_replace(t, "[^a-z0-9]", ""))
    return F.array_join(F.array_sort(F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*SALUTATIONS))), "|")


def name_tokens(name: Column) -> Column:
    """Name words as printed, without titles, credentials and initials."""
    bare = F.transform(_split(F.translate(F.coalesce(name, F.lit("")), ",;", "  ")), lambda t: F.regexp_replace(t, r"(?U)^\W+|\W+$", ""))
    return F.filter(bare, lambda t: (F.length(t) > 1) & ~F.lower(t).isin(*NOT_NAMES, *CREDENTIALS))


def has_doctor_credentials(is_doctor: Column, credentials: Column) -> Column:
    """Flagged as a doctor, or with a doctor's credentials."""
    found = F.exists(F.split(F.lower(F.coalesce(credentials, F.lit(""))), r"[\s,;.]+"), lambda t: t.isin(*CREDENTIALS))
    return F.coalesce(is_doctor, F.lit(False)) | found


def _tail(tokens: Column) -> Column:
    """The last token with the particles right before it; null if there is none."""
    def of(back: Column) -> Column:
        stop = F.array_position(F.transform(F.slice(back, 2, 1000), lambda t: ~F.lower(t).isin(*PARTICLES)), True).cast("int")
        n = let(stop, lambda k: F.when(k > 0, k).otherwise(F.size(back)))
        return F.when(F.size(back) > 0, F.array_join(F.reverse(F.slice(back, 1, n)), " "))

    return let(F.reverse(tokens), of)


def surname(name: Column) -> Column:
    """The surname: what stands before a comma, else the last name, with its particles."""
    def of(clean: Column) -> Column:
        return F.coalesce(F.when(clean.contains(","), _tail(name_tokens(F.substring_index(clean, ",", 1)))), _tail(name_tokens(clean)))

    return let(F.regexp_replace(F.trim(name), "[,.]+$", ""), of)


def surname_token(name: Column) -> Column:
    """Bare lower-case surname for comparing."""
    text = F.coalesce(name, F.lit(""))
    last = F.when(text.contains(","), F.substring_index(text, ",", 1)).otherwise(F.coalesce(F.try_element_at(_split(text), F.lit(-1)), F.lit("")))
    bare = F.regexp_replace(F.lower(last), "[^a-z0-9]", "")
    return F.when(bare == "dr", "").otherwise(bare)


def last_name_last(name: Column) -> Column:
    """``Last, First`` as ``First Last``."""
    last, rest = F.trim(F.substring_index(name, ",", 1)), F.trim(F.regexp_replace(name, "^[^,]*,?", ""))
    return F.when(name.contains(",") & (last != "") & (rest != ""), F.concat_ws(" ", rest, last)).otherwise(F.trim(name))


def format_author(name: Column, is_doctor: Column, credentials: Column) -> Column:
    """``Dr. Surname`` for doctors, other names with the last name last, null for what is no name."""
    def of(raw: Column) -> Column:
        doctor = let(surname(raw), lambda last: F.when(F.length(last) >= 2, F.concat(F.lit("Dr. "), last)))
        other = F.when(raw.contains(","), last_name_last(raw)).otherwise(F.array_join(name_tokens(raw), " "))
        return F.when(F.size(name_tokens(raw)) > 0, F.when(has_doctor_credentials(is_doctor, credentials), doctor).otherwise(other))

    return let(F.regexp_replace(F.trim(name), "[,.]+$", ""), of)


def clean_title(title: Column) -> Column:
    """Without titles of persons at its end or a date at its head, unless nothing would be left."""
    text = F.trim(title)
    for _ in range(4):
        text = F.trim(F.regexp_replace(text, TITLE_NOISE, ""))

    def of(text: Column) -> Column:
        rest = F.trim(F.regexp_replace(text, LEADING_DATE, ""))
        return let(rest, lambda r: F.when((F.length(r) >= 3) & F.exists(_split(r), lambda t: t.rlike(r"^\p{L}+$")), r).otherwise(text))

    return F.nullif(F.regexp_replace(let(text, of), "[ ,;:-]+$", ""), F.lit(""))


def patient_key(name: Column, dob: Column) -> Column:
    """What entries of one person share: name and birth date, as far as there are any."""
    both = F.named_struct(F.lit("who"), name_key(name), F.lit("born"), F.coalesce(canonical_date(dob), normalize_key(dob)))
    return let(both, lambda k: F.when((k["who"] != "") & (k["born"] != ""), F.concat_ws("|", k["who"], k["born"])).when(k["born"] != "", F.concat(F.lit("|"), k["born"])).otherwise(k["who"]))


def claimant_authored(author: Column, patient: Column) -> Column:
    """The author is the patient."""
    return (name_key(author) != "") & (name_key(author) == name_key(patient))


def tokens_shared(a: Column, b: Column) -> Column:
    """How many tokens two name keys have in common."""
    return F.size(F.array_intersect(_key_tokens(a), _key_tokens(b)))


def tokens_within(a: Column, b: Column) -> Column:
    """One of two name keys has no token that the other lacks, and neither is blank."""
    x, y = _key_tokens(a), _key_tokens(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def _key_tokens(key: Column) -> Column:
    return F.filter(F.split(F.coalesce(key, F.lit("")), r"\|"), lambda t: t != "")
