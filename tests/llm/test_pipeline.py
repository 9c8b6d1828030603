"""The pipeline's stages against plain versions, one after the other, and on awkward rows."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from pagegraph.llm import _shared
from pagegraph.llm._tokenize import FastEncoder
from pagegraph.llm.language_id import language_id
from pagegraph.llm.repeats import repeat_dedup
from pagegraph.llm.simhash import simhash_components
from pagegraph.llm.token_planes import token_planes
from pagegraph.llm.url_filter import url_filter
from tests.llm.test_archives_filters_mix import plain_matches

DIR = "/root/testdata/sf0.001"
TOKENIZER = pipeline.public_tokenizers.path("byte_bpe_50k.json")


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split(None)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_groups(texts):
    """The first of each group of texts, by comparing all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in range(len(texts))})


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")
def test_stages_like_plain_versions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(pipeline.STAGES)
    kept = stages["language"](spark, docs, DIR).cache()
    judged = {r.doc_id: r for r in language_id(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in judged.items() if r.lang_pred != "und" and r.score >= 0.4)
    assert all(r.lang is None or judged[r.doc_id].lang_pred == r.lang for r in kept.collect() if len((r.text or "").split()) > 30)

    rows = sorted(kept.collect(), key=lambda r: r.doc_id)
    once = stages["near_duplicates"](spark, kept, DIR).cache()
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.collect()) == [rows[i].doc_id for i in near_groups([r.text for r in rows])]

    rows = once.collect()
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    hit = {i for i, _ in plain_matches([r.text for r in rows], items)}
    clean = stages["decontamination"](spark, once, DIR).cache()
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for i, r in enumerate(rows) if i not in hit)

    mixed = stages["mixing"](spark, clean, DIR).cache()
    size, taken, copies = Counter(), Counter(), Counter(r.doc_id for r in mixed.collect())
    for r in clean.collect():
        size[r.source] += len((r.text or "").split())
        taken[r.source] += copies[r.doc_id] * len((r.text or "").split())
    assert set(copies) <= {r.doc_id for r in clean.collect()} and max(copies.values()) <= 3
    assert abs(sum(taken.values()) - sum(size.values())) < 0.1 * sum(size.values())

    library, start, want = FastEncoder(TOKENIZER).library, 0, []
    for r in sorted(mixed.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages["tokens"](spark, mixed, DIR).collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, pipeline.run(spark, DIR).collect()), key=lambda r: r[1]) == want


CLASH = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, copies string, key string, node string, `group` string, run string, contaminated string, start string, spans string, _row string"


@pytest.fixture(scope="module")
def awkward(spark):
    r = random.Random(5)
    words = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("lan", "mer", "nis", "pot", "rus")]
    prose = [" ".join(r.choice(words) for _ in range(60)) for _ in range(6)]
    long = " ".join(r.choice(words) for _ in range(260_000))  # more than one slice
    rows = [(k, t, "xx", "s1") for k, t in enumerate(prose)] + [(3, prose[3], "xx", "s1"), (None, prose[0], None, None), (None, None, None, None), (8, "", "yy", "s2"), (9, " \t\n", None, "s2"), (10, long, "xx", "s2"), (11, long + " end", "xx", None), (12, "123 !?", "xx", "s3")]
    return spark.createDataFrame([(d, t, g, s, None, *["x"] * 11) for d, t, g, s in rows], CLASH)


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_stages_on_awkward_rows(spark, awkward, name):
    stage = dict(pipeline.STAGES)[name]
    got = stage(spark, awkward, DIR)
    if name == "tokens":
        assert got.count() == awkward.count() and stage(spark, awkward.limit(0), DIR).count() == 0
        return
    assert got.columns == awkward.columns
    n = got.count()
    kept = {r.doc_id for r in got.select("doc_id").collect()}
    if name == "language":
        assert kept == {*range(6), 10, 11, None} and n == 10  # all with letters, the repeated one twice
    if name == "near_duplicates":
        assert kept == {*range(6), 8, 10, 12}  # null ids and blanks are copies, 11 is a near copy of 10
    if name == "decontamination":
        assert n == awkward.count()
    assert stage(spark, awkward.limit(0), DIR).count() == 0


def test_written_files_can_be_removed(spark, awkward):
    paths = list(_shared._made)
    token_planes(awkward, TOKENIZER, 2).count()
    path = _shared._made[-1]
    assert path not in paths and os.listdir(path)
    assert _shared.cleared(spark) == len(paths) + 1 and not os.path.exists(path) and not _shared._made


def test_operators_on_awkward_rows(spark, awkward):
    n = awkward.count()
    assert simhash_components(awkward).count() == n and simhash_components(awkward.limit(0)).count() == 0
    got = {r.doc_id: r for r in repeat_dedup(awkward).collect()}
    assert got[10].repeated and got[10].n_removed == got[10].n_bytes and got[11].n_removed == got[11].n_bytes - 4 and not got[12].repeated
    read = token_planes(awkward, TOKENIZER, 2).collect()
    assert sorted(r.doc_id is None for r in read).count(True) == 2 and [r.doc_id for r in read].count(3) == 2
    urls = spark.createDataFrame([], "page_id long, url string, host string")
    assert url_filter(urls, [("net", "/", "block")]).count() == 0
