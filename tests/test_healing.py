"""Torn and repeated documents."""

from pagegraph.operators.healing import heal_documents

SCHEMA = "file_id int, segment int, title string, date string, author string, recipient string, bucket string, patient_key string, page_start int, page_end int, signature string, has_imaging boolean, opens_printed boolean"


def healed(spark, *docs):
    base = dict(title="Note", date=None, author=None, recipient=None, bucket="clinical", patient_key="p", signature=None, has_imaging=False, opens_printed=False)
    rows = [(1, i, *[({**base, **d})[k] for k in ("title", "date", "author", "recipient", "bucket", "patient_key")], d.get("page", i), d.get("page", i), *[({**base, **d})[k] for k in ("signature", "has_imaging", "opens_printed")]) for i, d in enumerate(docs, 1)]
    return [r.document for r in heal_documents(spark.createDataFrame(rows, SCHEMA)).orderBy("segment").collect()]


def test_passes(spark):
    ann, bob = dict(author="Ann Lee"), dict(author="Bob Ray Stone")
    assert healed(spark, dict(signature="a|b", **ann), dict(signature="a", **ann)) == [1, None]
    assert healed(spark, ann, dict(title=None)) == [1, 1]
    assert healed(spark, ann, dict(title=None, has_imaging=True, bucket="imaging")) == [1, 2]
    assert healed(spark, ann, dict(title="Visit", author="Anne Lee")) == [1, 1]
    assert healed(spark, ann, bob) == [1, 2]
    assert healed(spark, ann, dict(title="Visit", author="Ann Lee", opens_printed=True)) == [1, 2]
    assert healed(spark, ann, dict(title="Visit", author="Ann Lee", page=9)) == [1, 2]
    assert healed(spark, dict(title="Letter", signature="x", **ann), dict(title="Other", bucket="imaging", **bob), dict(title="Letter", signature="x", bucket="clinical", page=20, **ann)) == [1, 2, None]
    assert healed(spark, dict(patient_key="p", **ann), dict(patient_key="q", **ann)) == [1, 2]
