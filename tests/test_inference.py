"""Model calls by clients that fail, and what is made of their answers."""

import json

from pagegraph.operators import inference as I


class Flaky:
    """Fails for prompts with an odd number."""

    def complete(self, prompt):
        if int(prompt) % 2:
            raise ValueError("odd")
        return json.dumps({"n": int(prompt)})


def nothing(seconds):
    """Does not wait."""


def test_errors_are_a_column(spark):
    rows = spark.createDataFrame([("1",), ("2",), (None,)], "prompt string")
    got = {r.prompt: (r.answer, r.error) for r in I.infer(rows, "prompt", Flaky(), tries=2, wait=nothing).collect()}
    assert got == {"1": (None, "ValueError: odd"), "2": ('{"n": 2}', None), None: (None, None)}


def test_the_stub_is_stable(spark):
    rows = spark.createDataFrame([("a",)], "prompt string")
    assert I.infer(rows, "prompt").collect() == I.infer(rows, "prompt").collect()
    assert [I.pause(k) for k in (0, 1, 9)] == [1, 2, 60]


def test_fallbacks(spark):
    units = spark.createDataFrame([("a", 1, "fa"), ("b", 1, "fb"), ("c", 2, "fc"), ("d", 3, "fd")], "unit_id string, chunk_id int, fallback string")
    answers = spark.createDataFrame([("a", "told"), ("b", ""), ("c", " ")], "unit_id string, answer string")
    assert {r.unit_id: r.text for r in I.answers_or_fallback(units, answers).collect()} == {"a": "told", "b": "fb", "d": "fd"}


def test_routing_labels(spark):
    labels = {"Admiting": True, "Attn/CC": True, "REFERRED_BY": True, "Requested-by:": True, "Adressed to": True, "copies  to": True, "Accounting": False, "Copyright": False, "Referral date": False, "to copy": False, "attends": False, None: False, "": False}
    rows = spark.createDataFrame([(k, v, "x") for k, v in labels.items()], "label string, want boolean, routing string")
    assert all(r.routing == r.want for r in I.with_routing(rows.drop("routing")).collect())
    assert I.with_routing(rows.drop("routing").limit(0)).count() == 0


class Partial:
    """Lacks a field at first."""

    def __init__(self):
        self.n = 0

    def complete(self, prompt):
        self.n += 1
        return "[]" if prompt == "list" else json.dumps({"clusters": []} if self.n % 2 == 0 else {"other": 1})


def test_answers_are_checked(spark):
    rows = spark.createDataFrame([("list",), ("ok",)], "prompt string").coalesce(1)
    got = {r.prompt: (r.answer, r.error) for r in I.infer(rows, "prompt", Partial(), tries=2, wait=nothing, required=I.required_fields("identities")).collect()}
    assert got["list"] == (None, "ValueError: the answer is not a JSON object") and got["ok"][0] == '{"clusters": []}'
    assert I.required_fields("opinion") == ("header", "definition", "opinion")


def test_evidence_and_log(spark):
    rows = spark.createDataFrame([(1, "finding", "Pain", 2), (1, "finding", "pain", 1), (1, "other", "pain", 3)], "doc int, kind string, text string, at int")
    assert sorted((r.kind, r.text) for r in I.distinct_evidence(rows, ["doc"], "at").collect()) == [("finding", "pain"), ("other", "pain")]
    assert "sha256" in I.loggable({"a": [{"base64": "xyz"}]})["a"][0]["base64"]
