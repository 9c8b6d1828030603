"""Dates as they stand in records, read by built-in functions only.

A date stays a string here: the numeric and compact forms are not checked against the calendar, so 02/31/2022
gives 2022-02-31. ``valid_date`` is the checked one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegraph.functions._let import let

# Month names, labels that may stand before a date, plausible years, the year from which two digits mean 19xx.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
LABEL = r"(?i)^\s*(?:date of birth|dob|d\.o\.b\.|review date)\s*[:#-]?\s*"
CLOCK = r"\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:[AaPp]\.?[Mm]\.?)?\s*[A-Z]{0,4}\s*$"
PLACEHOLDER = r"(?i)^\s*[MDY]{1,4}[\s\-/.]+[MDY]{1,4}[\s\-/.]+[MDY]{2,4}\s*$"
FIRST_YEAR, LAST_YEAR, PIVOT = 1900, 2100, 30


def _named(**fields: Column) -> Column:
    """A struct; its names are given as values, since aliases are lost where a lambda is resolved late."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def _blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def _whole(text: Column) -> Column:
    return text.try_cast("int")


def _month(name: Column) -> Column:
    """1 to 12 by the first three letters, else null."""
    short = F.lower(F.substring(name, 1, 3))
    return let(F.array_position(F.array(*[F.lit(m[:3].lower()) for m in MONTHS]), short).cast("int"), lambda k: F.when(k > 0, k))


def _named_month(name: Column) -> Column:
    """The same for whole names and three-letter ones only."""
    return F.when(F.lower(name).isin([m.lower() for m in MONTHS] + [m[:3].lower() for m in MONTHS]), _month(name))


def expand_year(year: Column) -> Column:
    """Two digits to four."""
    return F.when(year >= 100, year).when(year > PIVOT, year + 1900).otherwise(year + 2000)


def _parts(y: Column, m: Column, d: Column, calendar: bool = False) -> Column:
    """y, m and d together, or null if one is missing or, where asked, the day is not on the calendar."""
    def whole(s: Column) -> Column:
        ok = s["y"].isNotNull() & s["m"].isNotNull() & s["d"].isNotNull()
        if calendar:
            ok = ok & (s["y"] >= 1) & s["m"].between(1, 12) & (s["d"] >= 1) & (s["d"] <= _days_in(s["y"], s["m"]))
        return F.when(ok, s)

    return let(_named(y=y, m=m, d=d), whole)


def _days_in(y: Column, m: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def strip_clock(text: Column) -> Column:
    """Without a time of day at the end."""
    return F.trim(F.regexp_replace(text, CLOCK, ""))


def is_placeholder_date(raw: Column) -> Column:
    """A template such as MMM-DD-YYYY (D05); false for null."""
    return F.coalesce(raw.rlike(PLACEHOLDER), F.lit(False))


def _plain(text: Column) -> Column:
    tidy = F.translate(F.regexp_replace(F.trim(text), r"[.,;]+$", ""), ",", " ")
    tidy = F.regexp_replace(tidy, r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(tidy, r"\s*/\s*", "/"), r"\s+", " "))


def date_parts(text: Column, day_first: Column | bool = False) -> Column:
    """y, m and d of a date, or null (D01, D02); day_first settles 05/04/2022 only."""
    first = day_first if isinstance(day_first, Column) else F.lit(day_first)
    parts = let(_plain(text), lambda t: F.coalesce(*_tiers(t, first)))
    return let(parts, lambda p: F.when(p["y"].between(FIRST_YEAR, LAST_YEAR), p))


def _tiers(t: Column, day_first: Column) -> list[Column]:
    """What each form of date makes of the text; the first that fits counts."""
    def got(pattern: str, *groups: int) -> list[Column]:
        return [F.regexp_extract(t, pattern, g) for g in groups]

    tiers = []
    # Forms with four-digit years that have to be on the calendar.
    y, m, d = got(r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$", 1, 3, 4)
    tiers.append(_parts(_whole(y), _whole(m), _whole(d), calendar=True))
    for pattern, order in ((r"^(\d{4})-([A-Za-z]+)-(\d{1,2})$", (1, 2, 3)), (r"^(\d{4})/([A-Za-z]{3})/(\d{1,2})$", (1, 2, 3)), (r"^(\d{1,2})([- ])([A-Za-z]+)\2(\d{4})$", (4, 3, 1)), (r"^([A-Za-z]+) (\d{1,2})[ /](\d{4})$", (3, 1, 2))):
        y, m, d = got(pattern, *order)
        tiers.append(_parts(_whole(y), _named_month(m), _whole(d), calendar=True))
    y, m, d = (_whole(x) for x in got(r"^((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])$", 1, 2, 3))
    tiers.append(_parts(y, m, d))
    a, b, y = (_whole(x) for x in got(r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2,4})$", 1, 2, 3))
    tiers.append(let(_named(a=a, b=b, y=y), lambda n: _numeric_date(n["a"], n["b"], expand_year(n["y"]), day_first)))
    # Forms with a month name by its first letters; the day is not checked.
    for pattern, order in ((r"^(\d{1,2})[-/.\s]*([A-Za-z]{3,9})[-/.\s]*(\d{2,4})$", (3, 2, 1)), (r"^([A-Za-z]{3,9})[-/.\s]+(\d{1,2})[,\s/.-]+(\d{2,4})$", (3, 1, 2))):
        y, m, d = got(pattern, *order)
        tiers.append(_parts(let(_whole(y), expand_year), _month(m), _whole(d)))
    # Stray marks around a month and day: the year printed after them, else any year.
    noisy = r"\b([A-Za-z]{3,9})\.?\s+(0?[1-9]|[12]\d|3[01])\b"
    after, anywhere = F.regexp_extract(t, noisy + r".*?\b((?:19|20)\d{2})\b", 3), F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1)
    m, d = got(noisy, 1, 2)
    tiers.append(_parts(_whole(F.coalesce(_blank_to_null(after), anywhere)), _month(m), _whole(d)))
    return tiers


def _numeric_date(a: Column, b: Column, year: Column, day_first: Column) -> Column:
    """A date of numbers: which one is the month follows from the numbers where one is over 12, else from day_first."""
    swap = ((a > 12) & b.between(1, 12)) | (a.between(1, 12) & b.between(1, 12) & day_first)
    fits = swap | (a.between(1, 12) & (b >= 1))
    return F.when(fits, _named(y=year, m=F.when(swap, b).otherwise(a), d=F.when(swap, a).otherwise(b)))


def _read(raw: Column) -> Column:
    return strip_clock(F.regexp_replace(F.trim(raw), LABEL, ""))


def canonical_date(raw: Column, day_first: Column | bool = False) -> Column:
    """YYYY-MM-DD as a string, or null."""
    shown = let(date_parts(_read(raw), day_first), lambda p: F.when(p.isNotNull(), F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"])))
    return F.when(~is_placeholder_date(raw), shown)


def valid_date(raw: Column, day_first: Column | bool = False) -> Column:
    """The canonical date if it is on the calendar, as a date."""
    return F.to_date(F.try_to_timestamp(canonical_date(raw, day_first), F.lit("yyyy-MM-dd")))


def display_date(raw: Column, day_first: Column | bool = False) -> Column:
    """Month DD, YYYY; what cannot be read as it stands; null for templates and blanks."""
    months = F.array(*[F.lit(m) for m in MONTHS])
    shown = let(date_parts(_read(raw), day_first), lambda p: F.when(p.isNotNull(), F.format_string("%s %02d, %d", F.get(months, p["m"] - 1), p["d"], p["y"])))
    return F.when((raw != "") & ~is_placeholder_date(raw), F.coalesce(shown, _blank_to_null(_read(raw))))


def _numeric(raw: Column) -> tuple[Column, Column, Column]:
    a, b = (_whole(F.regexp_extract(F.trim(raw), r"^(\d{1,4})[-/.](\d{1,2})[-/.](\d{2,4})", g)) for g in (1, 2))
    return a, b, a.isNotNull() & (a <= 31)


def is_ambiguous(raw: Column) -> Column:
    """All numeric, and either number could be the month."""
    a, b, numeric = _numeric(raw)
    return F.coalesce(numeric & (a <= 12) & (b <= 12), F.lit(False))


def votes_day_first(raw: Column) -> Column:
    """The first number can only be a day."""
    a, b, numeric = _numeric(raw)
    return F.coalesce(numeric & (a > 12) & (b <= 12), F.lit(False))


def votes_month_first(raw: Column) -> Column:
    """The second number can only be a day."""
    a, b, numeric = _numeric(raw)
    return F.coalesce(numeric & (b > 12) & (a <= 12), F.lit(False))


def leading_date(text: Column) -> Column:
    """The date a paragraph opens with, canonical."""
    return canonical_date(_blank_to_null(F.regexp_extract(text, r"^\s*([A-Za-z]{3,9}\.?\s+\d{1,2},\s*\d{4})", 1)))


def month_day(iso: Column) -> Column:
    """MM-DD of a canonical date."""
    return F.substring(iso, 6, 5)


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return reduce(lambda a, b: F.coalesce(a, b), [_blank_to_null(F.trim(c)) for c in columns])
