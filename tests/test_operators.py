"""Operators on small tables, against plain Python where they are folds."""

import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagegraph.operators import checks, entries as E, evaluation, headers, linkage, rules, segments, store
from pagegraph.sources import files

ENTRY = "file_id bigint, entry_seq int, page_number int, marker_index int, marker_total int, starts_new boolean, include boolean, kind string, bucket string, title string, date string, author string, recipient string, custom_type string, patient_name string, patient_dob string, patient_identifier string, n_evidence int"
BLANK = dict(file_id=1, marker_index=0, marker_total=0, starts_new=False, include=True, kind="clinical", bucket="unknown", title=None, date=None, author=None, recipient=None, custom_type=None, patient_name=None, patient_dob=None, patient_identifier=None, n_evidence=1)


def entries(spark, *rows):
    data = [BLANK | {"entry_seq": i, "page_number": i} | r for i, r in enumerate(rows, 1)]
    names = [c.split()[0] for c in ENTRY.split(", ")]
    return spark.createDataFrame([tuple(d[n] for n in names) for d in data], ENTRY)


def segs(spark, *rows):
    return [r.segment for r in segments.segment_dated(entries(spark, *rows)).orderBy("entry_seq").collect()]


def test_printed_run_is_one_document(spark):
    run = [dict(marker_index=i, marker_total=5) for i in range(1, 6)]
    run[4] |= dict(kind="admin", starts_new=True, include=False, date="2022-01-02")
    fixed = E.repair_printed_runs(entries(spark, *run)).orderBy("entry_seq").collect()
    assert fixed[4].include and not fixed[4].starts_new and fixed[4].kind == "clinical" and fixed[0].starts_new
    assert segs(spark, *run) == [1] * 5
    assert segs(spark, *run[:3], *run[:3]) == [1, 1, 1, 2, 2, 2]


def test_admin_run_stays_out(spark):
    run = [dict(marker_index=i, marker_total=3, kind="admin", include=False) for i in range(1, 4)]
    assert not any(r.include for r in E.repair_printed_runs(entries(spark, *run)).collect())


def test_boundaries(spark):
    assert segs(spark, dict(date="2022-01-01"), dict(), dict(date="2022-01-02")) == [1, 1, 2]
    assert segs(spark, dict(patient_name="Ann Lee"), dict(), dict(patient_name="Bob Ray")) == [1, 1, 2]
    assert segs(spark, dict(page_number=1), dict(page_number=1, starts_new=True)) == [1, 2]
    assert segs(spark, dict(), dict(kind="admin", include=False), dict()) == [1, None, 2]
    assert segs(spark, dict(date="2022-01-01", bucket="clinical"), dict(date="2022-01-01", bucket="imaging", starts_new=True)) == [1, 2]
    assert segs(spark, dict(marker_index=1, marker_total=4), dict(marker_index=1, marker_total=3)) == [1, 2]


def _plain_runs(rows):
    """Positions of printed runs, by one pass."""
    runs, current, total = [], [], None
    for i, (index, n) in enumerate(rows):
        if not (0 < index <= n and n > 1):
            current = []
        elif index == 1:
            runs += [current] if current else []
            current, total = [i], n
        elif not current or n != total or index != len(current) + 1:
            current = []
        else:
            current.append(i)
            if len(current) == total:
                runs.append(current)
                current = []
    return runs + ([current] if current else [])


def test_printed_runs_against_one_pass(spark):
    r = random.Random(5)
    rows, expect = [], {}
    for file_id in range(60):
        marks, k = [], 0
        while len(marks) < 12:
            n = r.randrange(1, 5)
            marks += [(i, n) for i in range(r.randrange(1, 3), n + 1)][: r.randrange(0, n + 1)] or [(0, 0)]
        for i, (a, b) in enumerate(marks):
            rows.append(BLANK | dict(file_id=file_id, entry_seq=i, page_number=i, marker_index=a, marker_total=b))
        for run in _plain_runs(marks):
            expect |= {(file_id, i): run[0] for i in run}
    names = [c.split()[0] for c in ENTRY.split(", ")]
    df = spark.createDataFrame([tuple(d[n] for n in names) for d in rows], ENTRY)
    got = {(x.file_id, x.entry_seq): x.run_start for x in E.printed_runs(df).collect()}
    assert got == {k: expect.get(k) for k in got}


def test_patient_is_carried_over_admin_pages(spark):
    rows = E.carry_patient(entries(spark, dict(patient_name="Ann", patient_identifier="7"), dict(kind="admin"), dict(patient_dob="1970-01-01"))).orderBy("entry_seq").collect()
    assert [(r.patient_name, r.patient_dob, r.patient_identifier) for r in rows] == [("Ann", None, "7"), ("Ann", None, "7"), (None, "1970-01-01", None)]


def test_bundles(spark):
    def patients(*rows):
        df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows, 1)], "file_id int, bundle int, name string, dob string, page_start int, page_end int")
        return [r.patient for r in linkage.consolidate_bundles(df).orderBy("bundle").collect()]

    assert patients(("Ann Lee", "1970-01-01", 1, 3), ("Anne Leigh", "Jan 1, 1970", 9, 9)) == [1, 1]
    assert patients(("Ann Lee", None, 1, 3), ("Lee", None, 9, 9), ("Bob", None, 5, 5)) == [1, 1, 2]
    assert patients(("John Smith", None, 1, 3), ("Jane Smith", None, 9, 9)) == [1, 2]
    assert patients(("Ann Lee", "1970-01-01", 1, 3), ("Ann Lee", "1980-02-02", 9, 9)) == [1, 2]


def test_placeholders_go_to_the_nearest_bundle(spark):
    bundles = spark.createDataFrame([(1, 1, 1, 5), (1, 2, 10, 20)], "file_id int, bundle int, page_start int, page_end int")
    pages = spark.createDataFrame([(1, 3), (1, 6), (1, 9), (1, 40)], "file_id int, page_start int")
    assert {r.page_start: r.bundle for r in linkage.attach_placeholders(bundles, pages).collect()} == {3: 1, 6: 1, 9: 2, 40: 2}


def test_contradictions(spark):
    def found(*texts):
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "file_id int, para_pos int, text string")
        return [(r.first, r.second) for r in checks.contradictions(df).collect()]

    a, b = "May 4, 2022 chest x-ray. Normal.", "May 4, 2022 chest x-ray shows a fracture."
    assert found(a, b) == [(0, 1)] and found(b, a) == [(0, 1)]
    assert not found(a, b.replace("May 4", "May 5")) and not found(a, b.replace("chest", "knee")) and not found(a, a) and not found(a, "chest fracture")


def test_listing_rows(spark):
    docs = [(1, 1, 10, "2022-01-01", 8), (1, 2, 10, "2022-02-01", 1), (1, 3, 10, "2022-03-01", 1), (1, 4, 11, "2022-02-01", 9), (1, 5, 12, "2022-03-01", 7)]
    df = spark.createDataFrame(docs, "file_id int, doc_pos int, sole_page int, iso string, n_evidence int")
    assert sorted(r.doc_pos for r in checks.listing_rows(df).collect()) == [2, 3]
    assert checks.listing_rows(df.where("doc_pos <> 1")).count() == 0


def test_quality(spark):
    def score(**over):
        row = dict(date="2022-01-01", author="Ann", title="Note", claimant_authored=False, n_evidence=3, n_first_hand=3, n_pages=1, convention_resolved=True, broken=False) | over
        df = spark.createDataFrame([tuple(row.values())], "date string, author string, title string, claimant_authored boolean, n_evidence int, n_first_hand int, n_pages int, convention_resolved boolean, broken boolean")
        got = checks.quality(df).first()
        return got.score, got.needs_review

    assert score() == (1.0, False)
    assert score(date=None, author=None) == (0.4, True)
    assert score(date=None, author=None, title=None, n_evidence=0, n_first_hand=0, broken=True)[0] == 0.0
    assert score(author=None, claimant_authored=True) == (1.0, False)
    assert score(n_first_hand=0) == (0.8, False)


def test_rules(spark):
    listed = spark.createDataFrame([("a", "MRI", 2), ("b", "administrative", 1), ("c", "Other", 3)], "rule_id string, document_type string, sort_order int")
    docs = spark.createDataFrame([(1, "mri", "imaging"), (2, None, "admin"), (3, None, "clinical")], "id int, custom_type string, bucket string")
    assert {r.id: (r.tier, r.rule.rule_id) for r in rules.rule_for(docs, listed).collect()} == {1: (0, "a"), 2: (1, "b"), 3: (2, "c")}
    assert {r.id: r.tier for r in rules.rule_for(docs, listed.where("rule_id = 'x'")).collect()} == {1: None, 2: None, 3: None}


def test_deleting_the_default_promotes_another(spark):
    configs = spark.createDataFrame([("a", True, False, 1), ("b", False, True, 2), ("c", False, False, 0)], "config_id string, is_default boolean, is_seeded boolean, created_at int")
    assert {r.config_id: r.is_default for r in rules.delete_config(configs, "a").collect()} == {"b": True, "c": False}
    assert [r.config_id for r in rules.delete_config(configs.where("config_id = 'a'"), "a").collect()] == ["a"]


def test_store(spark):
    table = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "id string, v int, updated int")
    changed = spark.createDataFrame([("a", 2, 1), ("c", 3, 0)], "id string, v int, updated int")
    assert {r.id: r.v for r in store.upsert(table, changed, ["id"], "updated").collect()} == {"a": 2, "b": 1, "c": 3}
    tree = spark.createDataFrame([("1", "root", None), ("2", "sub", "1"), ("3", "leaf", "2")], "id string, name string, parent_id string")
    assert {r.id: r.path for r in store.breadcrumbs(tree).collect()}["3"] == ["root", "sub", "leaf"]


def test_the_newest_job_is_the_same_in_any_order_of_rows(spark):
    told = "job_id string, source_digest string, rule_config_id string, rule_config_version bigint, updated_at int"
    rows = [(f"j{k}", "d", None, None, 1 + (k > 3)) for k in (2, 9, 5, 4, 7, 1)]
    for order in (rows, rows[::-1]):
        assert [r.job_id for r in store.find_job(spark.createDataFrame(order, told), " D ", None, None).collect()] == ["j4"]


def test_logs_of_many_jobs(spark, tmp_path):
    rows = [(k, k % 70, ("01", "", None, "a/b \n\"c\"")[k % 4]) for k in range(280)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["log_round_trip"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=lambda r: r[2]) == [(f"job_{j}", s, k, False) for k, j, s in rows]

    log = str(tmp_path / "log")
    files.write_logs(spark.createDataFrame([(f"job_{j}", s, k) for k, j, s in rows], "job_id string, stage string, k bigint"), log)
    (tmp_path / "log" / "folder=0").mkdir(exist_ok=True)
    (tmp_path / "log" / "folder=0" / "torn.json").write_text('{"job_id": "job_1", "st\n\n')
    read = files.read_logs(spark, log, "k bigint").collect()
    assert sum(r.parse_error for r in read) == 1 and {r.k for r in read} == {None, *range(280)}
    homes = {f.parent.name for f in (tmp_path / "log").rglob("*.json")}
    assert len(homes) <= files.LOG_FOLDERS

    # One folder for each job and stage, where jobs are few.
    files.write_log(spark.createDataFrame([("job_a", "parse", 1), ("job_b", "parse", 2)], "job_id string, stage string, k bigint"), str(tmp_path / "few"))
    assert {(r.job_id, r.stage, r.k) for r in files.read_log(spark, str(tmp_path / "few"), "k bigint").collect()} == {("job_a", "parse", 1), ("job_b", "parse", 2)}
    assert (tmp_path / "few" / "job_id=job_a" / "stage=parse").is_dir()


def test_evaluation(spark):
    got = spark.createDataFrame([(1, 1, 2), (1, 4, 4)], "file_id int, page_start int, page_end int")
    counts = spark.createDataFrame([(1, 5), (2, 1)], "file_id int, page_count int")
    assert sorted((r.file_id, r.page) for r in evaluation.missing_pages(got, counts).collect()) == [(1, 3), (1, 5), (2, 1)]


def test_diagnoses_and_statement(spark):
    rows = [(1, i, "diagnosis", t) for i, t in enumerate(["Flu.", "flu", "Cold", "", "A", "B", "C", "D"])]
    df = spark.createDataFrame(rows, "file_id int, at int, kind string, text string")
    assert headers.diagnoses(df, ["file_id"], "at").first().diagnoses == "Flu, Cold, A, B, C"
    said = spark.range(1).select(headers.capture_statement(F.lit(338), F.lit(1), F.lit(9), F.lit(1)).alias("x")).first().x
    assert said == "Three hundred and thirty-eight pages have been provided. All information has been reviewed and summarized below as necessary."


def test_layout(spark):
    blocks = [(1, "t", "TABLE", None, None, None, ["c1", "c2"]), (1, "c1", "CELL", None, 1, 1, ["w1", "w2"]), (1, "c2", "CELL", None, 1, 2, []), (1, "w1", "WORD", "Date", None, None, []), (1, "w2", "WORD", "read", None, None, [])]
    df = spark.createDataFrame(blocks, "page_number int, id string, block_type string, text string, row_index int, column_index int, children array<string>")
    assert files.layout_tables(df).first().rows == [["Date read", ""]]
    long = spark.createDataFrame([([[str(i), "x"] for i in range(30)],)], "rows array<array<string>>")
    lines = long.select(files.table_lines(F.col("rows")).alias("x")).first().x
    assert len(lines) == 26 and lines[-1].startswith("… 5 further")


def test_rtf(spark):
    df = spark.createDataFrame([(1, 1, 1, "a{b}\\ é")], "file_id int, bundle int, para_pos int, text string")
    assert rb"a\{b\}\\ \u233?" in bytes(files.rtf_documents(df).first().rtf)
