"""Folds against plain models, written from the rules alone, on random files."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pagegraph.functions import text
from pagegraph.operators import linkage, listings, segments, store
from pagegraph.operators._distinct import per_value
from pagegraph.operators._fold import per_file
from tests.test_operators import BLANK, ENTRY

NAMES = [c.split()[0] for c in ENTRY.split(", ")]


def key(value):
    return re.sub("[^a-z0-9]", "", (value or "").lower())


def tokens(name):
    return sorted(t for t in re.sub("[^a-z ]", "", (name or "").lower()).split() if len(t) > 1)


def like(a, b):
    return SequenceMatcher(None, a, b).ratio()


def same_author(a, b):
    few, many = sorted((tokens(a), tokens(b)), key=len)
    free = list(many)
    for t in few:
        fit = [x for x in free if t == x or like(t, x) >= 0.7 or (max(len(t), len(x)) <= 4 and like(t, x) >= 0.6)]
        if not fit:
            return False
        free.remove(fit[0])
    return True


def same_title(a, b):
    x, y = key(a), key(b)
    return x == y or x in y or y in x or like(x, y) >= 0.75


def usable(e):
    return 0 < e["marker_index"] <= e["marker_total"] and e["marker_total"] > 1


def dated_segments(entries):
    """The steps of the rule, one after the other; entries are repaired and have their patients."""
    out, n, cur, last, before = [], 0, None, None, None
    for e in entries:
        prior, before = before, e
        if not e["include"] and e["kind"] in ("empty", "admin"):
            cur, last = None, None
            out.append(None)
            continue
        who = "|".join(tokens(e["patient_name"]) + ([e["patient_dob"]] if e["patient_dob"] else []))
        now = {"date": e["date"], "title": e["title"], "author": e["author"], "bucket": e["bucket"], "patient": who}
        if cur is None:
            cur, n = dict(now), n + 1
        else:
            date_changed = bool(now["date"] and cur["date"] and key(now["date"]) != key(cur["date"]))
            patient_changed = bool(who and cur["patient"] and who != cur["patient"])
            fits = now["bucket"] == cur["bucket"] or "unknown" in (now["bucket"], cur["bucket"])
            title_changed = bool(now["title"] and cur["title"]) and not same_title(now["title"], cur["title"])
            author_changed = bool(now["author"] and cur["author"]) and not same_author(now["author"], cur["author"])
            same_source = bool(now["date"] and cur["date"] and key(now["date"]) == key(cur["date"]) and fits)
            distinct = bool(now["date"]) and e["starts_new"] and (not fits or title_changed or author_changed)
            same_page = e["page_number"] == last and e["starts_new"]
            stated = usable(e) and e["marker_index"] > 1 and prior is not None and usable(prior) and prior["marker_total"] == e["marker_total"] and prior["marker_index"] == e["marker_index"] - 1
            opens = patient_changed or date_changed or (now["date"] and distinct and not same_source) or (now["date"] and same_page and not same_source) or (not now["date"] and same_page)
            if (opens and not stated) or (usable(e) and e["marker_index"] == 1):
                cur, n = dict(now), n + 1
            else:
                cur |= {k: v for k, v in now.items() if v and not (k == "bucket" and v == "unknown")}
        last = e["page_number"]
        out.append(n)
    return out


def random_entries(r, file_id):
    rows, page = [], 1
    for seq in range(1, r.randrange(2, 16)):
        page += r.random() < 0.7
        total = r.randrange(0, 4)
        rows.append(BLANK | dict(
            file_id=file_id, entry_seq=seq, page_number=page, marker_index=r.randrange(0, total + 2) if r.random() < 0.4 else 0, marker_total=total, starts_new=r.random() < 0.3, include=r.random() < 0.85,
            kind=r.choice(["clinical", "clinical", "imaging", "admin", "empty", "signature_only"]), bucket=r.choice(["unknown", "clinical", "imaging"]), title=r.choice([None, "Progress note", "Progres note", "MRI knee"]),
            date=r.choice([None, None, "2022-01-01", "2022.01.01", "2022-02-02"]), author=r.choice([None, "Ann Lee", "Anne Lee", "Bob Ray"]), patient_name=r.choice([None, None, None, "Joe Fox", "Jim Elk"]), patient_dob=r.choice([None, None, None, "1970-01-01"])))
    return rows


def test_dated_segments(spark):
    r = random.Random(20)
    rows = [e for f in range(400) for e in random_entries(r, f)]
    df = spark.createDataFrame([tuple(e[n] for n in NAMES) for e in rows], ENTRY)
    from pagegraph.operators.entries import carry_patient, repair_printed_runs

    ready = [x.asDict() for x in carry_patient(repair_printed_runs(df).drop("run_start")).collect()]
    want = {}
    for f in range(400):
        own = sorted((e for e in ready if e["file_id"] == f), key=lambda e: e["entry_seq"])
        want |= {(f, e["entry_seq"]): n for e, n in zip(own, dated_segments(own), strict=True)}
    got = {(x.file_id, x.entry_seq): x.segment for x in segments.segment_dated(df).collect()}
    assert got == want and len({n for n in want.values()}) > 5


def test_subsections(spark):
    r = random.Random(21)
    rows = [e | {"segment": 1 + e["entry_seq"] // 6} for f in range(150) for e in random_entries(r, f)]
    df = spark.createDataFrame([(*[e[n] for n in NAMES], e["segment"]) for e in rows], ENTRY + ", segment int")
    want, groups = {}, {}
    for e in rows:
        groups.setdefault((e["file_id"], e["segment"]), []).append(e)
    for (f, _), own in groups.items():
        n, date, author = 0, None, None
        for e in own:
            if e["kind"] not in ("empty", "signature_only"):
                if (e["date"] and date and key(e["date"]) != key(date)) or (e["author"] and author and not same_author(e["author"], author)):
                    n, date, author = n + 1, e["date"], e["author"]
                else:
                    date, author = e["date"] or date, e["author"] or author
            want[f, e["entry_seq"]] = n
    assert {(x.file_id, x.entry_seq): x.sub for x in segments.subsections_by_likeness(df).collect()} == want


def merged_people(bundles):
    """Bundles of a file merged by the rule: birth dates, names in order, then what lies between another's pages, until nothing changes."""
    people = []
    for b in bundles:
        same = next((p for p in people if b["dob"] and p["dob"] == b["dob"]), None)
        if same:
            same["tokens"] |= set(tokens(b["name"]))
            same["spans"].append((b["a"], b["b"]))
            same["ids"].append(b["id"])
        else:
            people.append({"ids": [b["id"]], "tokens": set(tokens(b["name"])), "dob": b["dob"], "spans": [(b["a"], b["b"])]})

    def ratio(x, y):
        return like("".join(sorted(x["tokens"])), "".join(sorted(y["tokens"]))) if x["tokens"] and y["tokens"] else 0

    def join(p, c):
        p["ids"] += c["ids"]
        p["tokens"] |= c["tokens"]
        p["dob"] = p["dob"] or c["dob"]
        p["spans"] += c["spans"]

    out = []
    for b in people:
        for p in out:
            if not (b["dob"] and p["dob"] and b["dob"] != p["dob"]) and b["tokens"] & p["tokens"] and (b["tokens"] <= p["tokens"] or p["tokens"] <= b["tokens"] or ratio(b, p) >= 0.85):
                join(p, b)
                break
        else:
            out.append(b)
    while True:
        for c in out:
            first, last = min(a for a, _ in c["spans"]), max(b for _, b in c["spans"])
            p = next((p for p in out if p is not c and any(b < first for _, b in p["spans"]) and any(a > last for a, _ in p["spans"])
                      and (p["tokens"] & c["tokens"] or (p["dob"] and c["dob"] and p["dob"][5:] == c["dob"][5:]) or ratio(p, c) >= 0.6)), None)
            if p:
                join(p, c)
                out.remove(c)
                break
        else:
            return {i: n for n, p in enumerate(out, 1) for i in p["ids"]}


def test_bundles(spark):
    r = random.Random(22)
    names = [None, "Ann Lee", "Lee", "Anne Lea", "Bob Ray", "Bob Raye Stone", "Robert Fox", "Rob Foxx", "Fox"]
    rows, want = [], {}
    for f in range(300):
        page, own = 1, []
        for k in range(1, r.randrange(2, 9)):
            end = page + r.randrange(3)
            own.append({"id": k, "name": r.choice(names), "dob": r.choice([None, None, "1970-01-01", "1960-01-01", "1980-05-05"]), "a": page, "b": end})
            page = max(1, end + r.randrange(-3, 4))
        want |= {(f, k): n for k, n in merged_people(own).items()}
        rows += [(f, b["id"], b["name"], b["dob"], b["a"], b["b"]) for b in own]
    df = spark.createDataFrame(rows, "file_id int, bundle int, name string, dob string, page_start int, page_end int")
    got = linkage.consolidate_bundles(df)
    assert {(x.file_id, x.bundle): x.patient for x in got.collect()} == want
    named = got.select("file_id", "bundle", "patient", "name", F.lit(1).alias("n_documents"))
    assert linkage.patient_names(named).count() <= len(set(want))


def test_fold_of_a_file_in_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(f, k) for f, n in ((1, 40), (2, 1), (3, 7), (None, 9), (5, 15)) for k in range(n)], "file_id int, k int")
        got = per_file(df, "k", ["k"], "n", "integer", lambda rows: [len(rows)] * len(rows)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.file_id, r.n) for r in got} == {(1, 40), (2, 1), (3, 7), (None, 9), (5, 15)} and len(got) == 72


def test_per_value(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, None), (3, "a", "x"), (4, "a", "x")], "k int, a string, b string")
    got = per_value(rows, ["a", "b"], a=F.concat_ws("-", "a", "b"), c=F.lit(7))
    assert sorted((r.k, r.a, r.b, r.c) for r in got.collect()) == [(1, "a", None, 7), (2, "", None, 7), (3, "a-x", "x", 7), (4, "a-x", "x", 7)]


@pytest.mark.parametrize("patterns", [text.PERSONAL, text.PERSONAL_STRICT])
def test_scrub_like_plain_patterns(spark, patterns):
    r = random.Random(23)
    parts = ["call 416-555-1234", "12 Main Street", "7 Elm St. Apt", "at 5 Oak Rd.x", "SIN: 123", "a.b@c.org", "(416) 555 1234 x", "A1234-5678 9012", "1234567890", "est. The", "99 words and more - words", "Dr.", "\n", " ", ";"]
    raw = [" ".join(r.choice(parts) for _ in range(r.randrange(8))) for _ in range(400)] + ["", "12 " * 300]

    def plain(t):
        for p in patterns:
            t = re.sub(p, "", t, flags=re.ASCII)
        return re.sub(r"\s{2,}", " ", t).strip(" ,;:|")

    df = spark.createDataFrame(list(enumerate(raw)), "i int, t string")
    assert [x.t for x in df.select("i", text.pii_scrub(F.col("t"), patterns).alias("t")).orderBy("i").collect()] == [plain(t) for t in raw]


def test_lists_come_in_order(spark):
    jobs = spark.createDataFrame([(1, 5, 2.0, 1), (2, None, 9.0, 1), (3, 7, None, 2), (4, 7, 1.0, 0)], "job_id int, updated_at int, cost_usd double, calls int")
    assert [r.job_id for r in listings.ordered_jobs(jobs).collect()] == [3, 4, 1, 2]
    assert [r.job_id for r in listings.jobs_by_cost(jobs).collect()] == [2, 1, 3]
    users = spark.createDataFrame([(1,), (None,)], "who int")
    assert [r.job_id for r in store.orphans(jobs, users, "job_id", "who").orderBy("job_id").collect()] == [2, 3, 4]
