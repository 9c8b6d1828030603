"""Exact, line, near and byte dedup against brute force on small tables with nulls, blanks, ties and repeated rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pagegraph.llm import near_groups as g
from pagegraph.llm import repeats
from pagegraph.llm.components import components
from pagegraph.llm.exact_dedup import exact_dedup
from pagegraph.llm.line_dedup import line_dedup
from pagegraph.llm.near_groups import near_dedup
from pagegraph.llm.queries import op9_repeated_bytes
from pagegraph.llm.repeats import repeat_dedup
from pagegraph.llm.simhash import simhash_components

SCHEMA = "doc_id long, text string, fp long, copies int"


def frame(spark, rows):
    """Rows of doc_id and text, with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(d, t, 1, 2) for d, t in rows], SCHEMA)


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    base = [words(r, r.randrange(1, 120)) for _ in range(40)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[0]) for i in range(30)] + [(200, base[1].replace(" ", "  \n")), (201, None), (202, ""), (203, " \t"), (204, "é"), (None, base[2])]
    for i in range(30):
        w = base[i % 10].split()
        w[r.randrange(len(w))] = "changed"
        out.append((300 + i, " ".join(w)))
    return out + [(5, base[5])]


def test_exact(spark, rows):
    got = exact_dedup(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d))
    want = []
    for d, t in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[bare])[2]
        want.append((d, keep, len(groups[bare]), d == keep, hashlib.sha256(bare.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    clash = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, keep_id int, kept int, group_size int")
    for n in (1, 30):  # one run, and as many as need two rounds
        assert sorted(map(tuple, exact_dedup(clash.repartition(n)).collect()), key=str) == sorted(want, key=str)
    assert exact_dedup(frame(spark, [])).count() == 0


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(len(w) - 2, 1 if w else 0))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("wide", [64, 1])
def test_simhash(spark, rows, wide):
    # Short texts of few words, so that many fingerprints are near each other.
    r = random.Random(4)
    more = rows + [(1000 + i, words(r, r.randrange(1, 4), 6)) for i in range(60)]
    got = {}
    for x in simhash_components(frame(spark, more), wide=wide).collect():
        got.setdefault((x.doc_id, x.fingerprint), x.component_id)
    prints = [fingerprint(t) for _, t in more]
    parent = list(range(len(more)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(more)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(more):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    assert got == {(d, f"{prints[i]:016x}"): least[root(i)] for i, (d, _) in enumerate(more)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def covered(texts, width):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1000, 1])
def test_repeated_bytes(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    r = random.Random(6)
    passages = [words(r, 90) for _ in range(4)] + ["é" * 300, "a" * 1000]
    rows = []
    for i in range(50):
        parts = [words(r, r.randrange(60)) for _ in range(3)]
        parts.insert(r.randrange(3), r.choice(passages)[r.randrange(40) : -1 - r.randrange(40)])
        rows.append((i, " ".join(parts)))
    rows += [(60, rows[0][1]), (61, rows[0][1]), (62, None), (63, ""), (64, "b" * 399), (65, "b" * 399), (66, "c" * 401), (7, rows[7][1]), (None, rows[3][1])]
    got = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeat_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted(((d, *x) for (d, _), x in zip(rows, covered([t for _, t in rows], 400), strict=True)), key=str)
    assert repeat_dedup(frame(spark, [])).count() == 0


def test_repeated_bytes_kept_text(spark, tmp_path):
    r = random.Random(12)
    long, short = (" ".join(f"x{r.randrange(1000):0{n}}" for _ in range(60)) for n in (7, 4))
    assert len(long) >= 400 > len(short)
    own = [words(r, 80) for _ in range(6)]
    texts = [f"{own[0]} {long} {own[1]}", f"{own[2]}\n{long}\n{own[3]}", f"{own[4]} {short}", f"{short} {own[5]}", own[0][:300], None, long + "é" + own[1][:200], long + "è" + own[5][:200]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in op9_repeated_bytes(spark, str(tmp_path)).collect()}
    assert all(long not in x.kept_text for x in got.values())
    assert [got[k].kept_text for k in (2, 3, 4, 5)] == [*texts[2:5], ""]  # the shorter passage is below 400 bytes
    assert [got[k].kept_text for k in (0, 1)] == [f"{own[0]}  {own[1]}", f"{own[2]}\n\n{own[3]}"]
    assert all(hashlib.sha256(got[k].kept_text.encode()).hexdigest() == got[k].kept_sha256 for k in range(6))
    assert [got[k].kept_text for k in (6, 7)] == ["\ufffd" + own[1][:200], "\ufffd" + own[5][:200]]  # both begin with the same byte, which goes


def test_least_places():
    r = np.random.default_rng(1)
    for n, width in ((1, 1), (5, 3), (100, 7), (64, 64), (3, 5)):
        v = r.integers(0, 5, n).astype(np.uint64)
        want = [i + int(np.argmin(v[i : i + width])) for i in range(n - width + 1)]
        assert repeats.least_places(v, width).tolist() == want


def test_lines(spark):
    r = random.Random(8)
    pool = [f"line {i}" for i in range(12)]
    long = [words(r, 80)[:n] for n in (199, 200, 300)]
    rows = [(i, "\n".join(r.choice(pool + long) for _ in range(r.randrange(12)))) for i in range(40)] + [(44, long[1]), (45, f"{long[2]}\n"), (50, None), (51, ""), (52, "\n\n\n\n"), (53, "\n".join(pool)), (54, "\n".join(pool))]
    got = {x.doc_id: (x.text, x.n_removed) for x in line_dedup(frame(spark, rows)).collect()}
    first = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            if first.setdefault(tuple(lines[i : i + 3]), (d, i)) != (d, i):
                gone |= {i, i + 1, i + 2}
        gone |= {i for i, x in enumerate(lines) if len(x) >= 200 and first.setdefault(x, (d, i)) != (d, i)}
        assert got[d] == ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    clash = spark.createDataFrame([(None, "a\nb\nc", 5, 6, 7), (1, "a\nb\nc", 5, 6, 7), (1, "a\nb\nc", 5, 6, 7)], "doc_id long, text string, n_lines int, n_removed int, runs int")
    assert sorted((x.doc_id or 0, x.n_lines, x.n_removed) for x in line_dedup(clash).collect()) == [(0, 3, 3), (1, 3, 0), (1, 3, 0)]
    assert line_dedup(clash.where("doc_id > 5")).count() == 0


def test_near(spark):
    r = random.Random(9)
    base = [words(r, 200, 5000) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)] + [(20, base[0]), (21, None), (22, " ")]
    for i in range(12):
        w = base[i].split()
        for k in range(0, 200, 50 if i < 8 else 4):
            w[k] = "changed"
        rows.append((40 + i, " ".join(w)))
    kept = sorted(x.doc_id for x in near_dedup(frame(spark, rows)).collect())
    assert kept == sorted([*range(12), 21, *range(48, 52)])
    assert near_dedup(frame(spark, rows)).columns == ["doc_id", "text", "fp", "copies"]
    assert near_dedup(frame(spark, [])).count() == 0


def test_near_repeated_line(spark):
    # The same distinct shingles but for a few; one text of each pair has a line of 25 words forty times.
    r = random.Random(10)
    base = [words(r, 400, 100_000) for _ in range(20)]
    lines = [words(r, 25, 100_000) for _ in base]
    rows = [(i, f"{t}\n{x}") for i, (t, x) in enumerate(zip(base, lines, strict=True))]
    rows += [(100 + i, f"{t}\n" + "\n".join([x] * 40)) for i, (t, x) in enumerate(zip(base, lines, strict=True))]
    assert sorted(x.doc_id for x in near_dedup(frame(spark, rows)).collect()) == list(range(20))


def similar_prints(texts):
    """Pairs that share a variant and are close by sketch, fingerprint and shingles, found by comparing all."""
    words = g.words_of(pa.array(texts), lower=True)
    start, end, count = g.shingles_of(words, g.SHINGLE)
    ends, h = np.cumsum(count), g.xxh64(words.data, start, end, g.SEED)
    sets = [set(h[e - c : e].tolist()) for e, c in zip(ends, count, strict=True)]
    flat = np.array([x for s in sets for x in sorted(s)], np.uint64)
    prints = np.stack([g.fingerprints_of(g._spread(flat, k), np.array([len(s) for s in sets])) for k in range(g.WORDS + 1)], axis=1)
    for i in range(len(texts)):
        differ = prints[i] ^ prints[i + 1 :]
        shares = np.zeros(len(differ), bool)
        for k in range(g.PER_WORD):
            segment = (differ[:, : g.WORDS] >> np.uint64(k * g.SEGMENT_BITS)) & np.uint64((1 << g.SEGMENT_BITS) - 1)
            shares |= (np.bitwise_count(segment) <= 1).any(axis=1)
        sketch = np.bitwise_count(differ[:, g.WORDS] & np.uint64((1 << 63) - 1)) <= g.SKETCH_MOST
        for j in np.flatnonzero(shares & sketch & (np.bitwise_count(differ).sum(axis=1) <= g.WHOLE_MOST)) + i + 1:
            if len(sets[i] & sets[j]) >= g.SIMILAR * len(sets[i] | sets[j]):
                yield i, int(j)


@pytest.mark.parametrize("more", [{}, {"wide": 3}, {"wide": 3, "held": 7, "block_bytes": 300_000}])
def test_near_large_family(spark, more):
    # Texts that share most of their words but are not similar enough, each with a copy that is.
    r = random.Random(11)
    shared = words(r, 260, 100_000)
    texts = [f"{shared} {words(r, 40, 100_000)}" for _ in range(500)]
    for t in texts[:500]:
        w = t.split()
        w[20 : 20 + 16] = words(r, 16, 100_000).split()
        texts.append(" ".join(w))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in similar_prints(texts):
        parent[max(root(i), root(j))] = min(root(i), root(j))
    want = sorted({root(i) for i in range(len(texts))})
    assert 1 < len(want) < 600
    assert sorted(x.doc_id for x in near_dedup(frame(spark, enumerate(texts)), **more).collect()) == want


def test_near_recall():
    # Of pairs whose similarity is just over the bound, all but a few in a hundred share a variant and pass the tests of the fingerprint.
    r = np.random.default_rng(3)
    shared = r.integers(0, 1 << 62, (2000, 400), np.int64).astype(np.uint64)
    own = r.integers(0, 1 << 62, (2, 2000, 50), np.int64).astype(np.uint64)  # 400 of 500 shingles in common
    prints = [np.stack([g.fingerprints_of(g._spread(np.concatenate([shared, o], axis=1).ravel(), k), np.full(2000, 450)) for k in range(g.WORDS + 1)], axis=1) for o in own]
    differ = prints[0] ^ prints[1]
    shares = np.zeros(2000, bool)
    for k in range(g.PER_WORD):
        segment = (differ[:, : g.WORDS] >> np.uint64(k * g.SEGMENT_BITS)) & np.uint64((1 << g.SEGMENT_BITS) - 1)
        shares |= (np.bitwise_count(segment) <= 1).any(axis=1)
    sketch = np.bitwise_count(differ[:, g.WORDS] & np.uint64((1 << 63) - 1)) <= g.SKETCH_MOST
    assert (shares & sketch & (np.bitwise_count(differ).sum(axis=1) <= g.WHOLE_MOST)).mean() > 0.955


@pytest.mark.parametrize("more", [{}, {"odd_rows": 2}])
def test_near_repeated_rows(spark, more):
    r = random.Random(12)
    one, two, three = (words(r, 200, 5000) for _ in range(3))
    rows = [(1, one), (1, one), (None, one), (None, two), (None, two), (None, f"{two} more"), (7, three), (None, None), (None, "")]
    got = near_dedup(frame(spark, rows), **more).collect()
    assert sorted((x.doc_id or 0, (x.text or "")[:40]) for x in got) == sorted([(1, one[:40]), (0, two[:40]), (7, three[:40]), (0, "")])
