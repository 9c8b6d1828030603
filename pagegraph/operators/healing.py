"""Documents that a scan tore apart or holds twice.

Three passes over the documents of a file, in order: copies and headless remainders join what is right before them;
visits of one provider's chart become one document; copies of any earlier document go. Each document is compared with
the one that has grown before it, so this is a fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegraph.functions.fuzzy import SURNAME, keys_equivalent, ratio, titles_alike
from pagegraph.functions.names import name_key, surname_token
from pagegraph.functions.text import normalize_key
from pagegraph.operators._fold import per_file

# Pages between two visits of one chart, with a name in common and without.
SERIES_GAP, HEADLESS_GAP = 5, 2
UNKNOWN = "unknown"
_KEYS = ("_title", "_date", "_author", "_recipient")


class _Document:
    """A document, and those that have joined it."""

    def __init__(self, row: dict):
        self.values, self.members, self.last = dict(row), [row["segment"]], row["page_end"]

    def fits_patient(self, other: _Document) -> bool:
        a, b = self.values["patient_key"], other.values["patient_key"]
        return not a or not b or a == b

    def holds(self, other: _Document) -> bool:
        """The other one is a copy of this, whole or in part."""
        mine, theirs = self.values, other.values
        same_title = bool(theirs["_title"]) and mine["_title"] == theirs["_title"]
        dates_fit = not mine["_date"] or not theirs["_date"] or mine["_date"] == theirs["_date"]
        return same_title and dates_fit and bool(theirs["signature"]) and theirs["signature"] in (mine["signature"] or "")

    @property
    def headless(self) -> bool:
        """It says neither what it is nor when nor by whom; an image alone is a document all the same."""
        v = self.values
        return not v["has_imaging"] and not (v["_title"] or v["_date"] or v["_author"])

    def _name(self, other: _Document, who: str) -> bool | None:
        """Whether a name agrees; None where one of them has none."""
        a, b = self.values[f"_{who}"], other.values[f"_{who}"]
        if not a or not b:
            return None
        s, t = self.values[f"_{who}_surname"], other.values[f"_{who}_surname"]
        return keys_equivalent(a, b) or bool(s and t and ratio(s, t) >= SURNAME)

    def continues(self, other: _Document) -> bool:
        """The other one is a further visit of this chart."""
        mine, theirs = self.values, other.values
        buckets = {mine["bucket"], theirs["bucket"]}
        names = (self._name(other, "author"), self._name(other, "recipient"))
        if theirs["opens_printed"] or not self.fits_patient(other) or (len(buckets) > 1 and UNKNOWN not in buckets) or False in names:
            return False
        gap = theirs["page_start"] - self.last
        if True in names:
            return 0 <= gap <= SERIES_GAP
        bare = any(not (v["_title"] or v["_author"] or v["_recipient"]) for v in (mine, theirs))
        unsigned = not theirs["_author"] and not theirs["_recipient"]
        same_form = buckets == {"clinical"} and titles_alike(mine["_title"], theirs["_title"])
        return (bare or unsigned or same_form) and 0 <= gap <= HEADLESS_GAP

    def take(self, other: _Document) -> None:
        self.members += other.members
        self.last = other.last
        for k in (*_KEYS, "_author_surname", "_recipient_surname", "patient_key"):
            self.values[k] = self.values[k] or other.values[k]
        self.values["signature"] = "|".join(sorted(x for x in f"{self.values['signature'] or ''}|{other.values['signature'] or ''}".split("|") if x))


def _healed(rows: list[dict]) -> list[int | None]:
    near: list[_Document] = []
    for d in map(_Document, rows):
        before = near[-1] if near else None
        if before and before.fits_patient(d) and before.holds(d):
            continue
        before.take(d) if before and before.fits_patient(d) and d.headless else near.append(d)
    series: list[_Document] = []
    for d in near:
        series[-1].take(d) if series and series[-1].continues(d) else series.append(d)
    kept: list[_Document] = []
    for d in series:
        if not any(k.fits_patient(d) and k.holds(d) for k in kept):
            kept.append(d)
    place = {m: n for n, d in enumerate(kept, 1) for m in d.members}
    return [place.get(r["segment"]) for r in rows]


def heal_documents(documents: DataFrame) -> DataFrame:
    """documents with document, the number of what each has become part of, null for copies.

    documents: file_id, segment, title, date, author, recipient, bucket, patient_key, page_start, page_end, signature,
    has_imaging, opens_printed.
    """
    keys = {"_title": normalize_key(F.col("title")), "_date": normalize_key(F.col("date"))}
    for who in ("author", "recipient"):
        keys |= {f"_{who}": name_key(F.col(who)), f"_{who}_surname": surname_token(F.col(who))}
    needed = ["segment", "bucket", "patient_key", "page_start", "page_end", "signature", "has_imaging", "opens_printed", *keys]
    return per_file(documents.withColumns(keys), "segment", needed, "document", "integer", _healed).drop(*keys)
