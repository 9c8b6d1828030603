"""Scalar functions against expectations written down by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagegraph.functions import dates, fuzzy, names, text


def one(spark, column, *values):
    kinds = {str: "string", int: "bigint", bool: "boolean", type(None): "string", float: "double"}
    schema = ", ".join(f"c{i} {kinds[type(v)]}" for i, v in enumerate(values))
    row = spark.createDataFrame([values], schema)
    return row.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def many(spark, column, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in rows.select("i", column(F.col("c")).alias("x")).orderBy("i").collect()]


# Raw date, as it is shown, and as it is shown where the day comes first (None: the same).
DATES = [
    ("02/09/71", "February 09, 1971", "September 02, 1971"), ("02-09-2013", "February 09, 2013", "September 02, 2013"), ("10.12.08", "October 12, 2008", "December 10, 2008"),
    ("7/8/2019", "July 08, 2019", "August 07, 2019"), ("2017-11-30", "November 30, 2017", None), ("2017/11/30", "November 30, 2017", None), ("Jan 31 2020", "January 31, 2020", None), ("03Oct15", "October 03, 2015", None),
    ("14-Feb-18 09:05 EST", "February 14, 2018", None), ("14-Feb-2018 23:59", "February 14, 2018", None), ("June 5, 2021 8:00:01 a.m.", "June 05, 2021", None),
    ("25/12/2016", "December 25, 2016", None), ("Date of Birth: June 5, 1983", "June 05, 1983", None), ("March 2nd/2011", "March 02, 2011", None), ("20111203", "December 03, 2011", None),
    ("Nov 9. 22/2010", "November 09, 2010", None), ("tomorrow", "tomorrow", None), ("June 5, 83", "June 05, 1983", None), ("2019-02-30", "2019-02-30", None),
]


def test_display_dates(spark):
    raw = [d[0] for d in DATES]
    assert many(spark, dates.display_date, raw) == [d[1] for d in DATES]
    assert many(spark, lambda c: dates.display_date(c, True), raw) == [d[2] or d[1] for d in DATES]


def test_canonical_dates(spark):
    raw = ["02/31/2022", "45/04/2022", "99Jul22", "MMM-DD-YYYY", "May 4, 166", None, "", "2022-02-30", "Sept 9, 2021", "9 Aug 2021"]
    assert many(spark, dates.canonical_date, raw) == ["2022-02-31", "2022-04-45", "2022-07-99", None, None, None, None, None, "2021-09-09", "2021-08-09"]
    assert many(spark, dates.valid_date, ["02/31/2022", "02/28/2022"]) == [None, datetime.date(2022, 2, 28)]


def test_ambiguity_and_votes(spark):
    raw = ["05/04/2022", "11/12/22", "13/04/2022", "04/13/2022", "2022-05-04", "May 04, 2022", ""]
    assert many(spark, dates.is_ambiguous, raw) == [True, True, False, False, False, False, False]
    assert many(spark, dates.votes_day_first, raw) == [False, False, True, False, False, False, False]
    assert many(spark, dates.votes_month_first, raw) == [False, False, False, True, False, False, False]


def test_numbers_in_words(spark):
    asked = {0: "zero", 1: "one", 21: "twenty-one", 40: "forty", 100: "one hundred", 338: "three hundred and thirty-eight", 1000: "one thousand", 1024: "one thousand and twenty-four", 1100: "one thousand one hundred", 12000: "12000", -1: "-1"}
    assert many(spark, text.spell_number, list(asked), "bigint") == list(asked.values())


def test_names(spark):
    assert many(spark, names.name_key, ["Dr. Ann O'Neil-Smith", "SMITH, Ann Oneil", None, "B."]) == ["ann|oneil|smith", "ann|oneil|smith", "", ""]
    assert many(spark, names.surname, ["Tom du Rand", "Jan van der Berg, MD", "du Rand, Tom", "Dr.", None]) == ["du Rand", "van der Berg", "du Rand", None, None]
    assert one(spark, names.format_author, "van der Berg, Jan", False, "MD") == "Dr. van der Berg"
    assert one(spark, names.format_author, "Smith, Ann B", False, None) == "Ann B Smith"
    assert one(spark, names.format_author, "Dr.", True, None) is None
    assert many(spark, names.clean_title, ["29Jul22 Progress Note", "Letter to Dr.", "May 2022 Review", "2022-07-29", None, "  "]) == ["Progress Note", "Letter", "May 2022 Review", "2022-07-29", None, None]
    assert one(spark, names.patient_key, "Ann Smith", "May 4, 1970") == "ann|smith|1970-05-04"


def test_redaction(spark):
    raw = ["key sk-abcdefghijklmnop1234 end", "Bearer abcdefghijklmnopqrst", "https://me:pw@host/x", "api_key=abc def", "plain", None]
    assert many(spark, text.redact_secrets, raw) == ["key [redacted] end", "[redacted]", "https://[redacted]@host/x", "[redacted] def", "plain", ""]


def test_scrub(spark):
    raw = ["call 416-555-1234 now", "mail a.b@c.org, thanks", "12 Main Street", "+1 (743) 555-3824"]
    assert many(spark, text.pii_scrub, raw[:2]) == ["call now", "mail , thanks"]
    assert many(spark, lambda c: text.pii_scrub(c, text.PERSONAL_STRICT), raw[3:]) == [""]


def test_fuzzy():
    assert fuzzy.keys_equivalent("ann|smith", "ann|smyth") and not fuzzy.keys_equivalent("ann|smith", "bob|jones") and not fuzzy.keys_equivalent("", "ann")
    assert fuzzy.titles_alike("progressnote", "note") and not fuzzy.titles_alike("progressnote", "mri")


@pytest.mark.parametrize("content, k", [('{"k": 1}', 1), ('```json\n{"k": 2}\n```', 2), ('Here: {"k": 3} done', 3), ("nothing", None), ("", None)])
def test_lenient_json(spark, content, k):
    got = one(spark, lambda c: text.json_lenient(c, "k int"), content)
    assert (got.k if got else None) == k
