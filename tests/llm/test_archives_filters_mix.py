"""WARC archives, URL rules, mixing, language ID and decontamination on small tables."""

import hashlib
import io
import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import zstandard

from pagegraph.llm import decontaminate as decon
from pagegraph.llm import warc
from pagegraph.llm.decontaminate import ItemIndex, contamination, decontaminated, flagged
from pagegraph.llm.language_id import LanguageModel, accepted, codewords, language_id
from pagegraph.llm.mixing import mixed, mixing_plan
from pagegraph.llm.url_filter import UrlTrie, url_filter

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.org", "/x", "block")]


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://a.b.NET/", "http://net", "http://x.example.net/en/1?q", "http://example.net/enx", "https://www.example.com/de/?a://b/c", "http://m.org/fr/2#t", "http://myexample.com/de/", "http://a.org/xyz", "http://h/p q://z"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(pages, RULES).collect()}
    for i, url in enumerate(urls):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(h.count("."), len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == (host, path, *(max(fits)[2:] if fits else (None, "allow"))), url
    assert UrlTrie([("a", "/", "allow"), ("a", "/", "block")]).match("a", "/") == ("a/", "block")
    with pytest.raises(ValueError):
        UrlTrie([("a", "/", "perhaps")])


def test_warc_round_trip(spark, tmp_path):
    r = random.Random(1)
    body = "".join(f"<p>{r.random()}é</p>" for _ in range(200))
    rows = [(1, "http://a/ b", body), (2, None, body), (5, "http://c/", body), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (None, "u", body + "x")]
    pages = spark.createDataFrame([(*x, 9) for x in rows], "page_id long, url string, html string, payload_bytes int")
    got = sorted(warc.archive(pages, f"{tmp_path}/w", with_payload=True).collect(), key=lambda x: (x.page_id is None, x.page_id))
    assert [(x.page_id, x.record_type, x.refers_to) for x in got] == [(1, "revisit", 5), (2, "revisit", 5), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (None, "response", None)]
    by_id = {x[0]: x for x in rows}
    for x in got:
        data = (by_id[x.page_id][2] or "").encode()
        assert (x.payload_bytes, x.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert x.payload is None if x.record_type == "revisit" else bytes(x.payload) == data
    assert got[0].url == "http://a/%20b"
    assert warc.archive(pages.where("page_id = 99")).count() == 0


def test_warc_file_form():
    out = io.BytesIO()
    writer = warc.WarcWriter(out)
    data = [warc.record(i, f"http://h/{i}", f"<html>{'text of the page ' * 30}{i}</html>".encode(), None) for i in range(300)]
    for d in data:
        writer.add(d)
    writer.close()
    raw = out.getvalue()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC
    assert list(warc.records_of(io.BytesIO(raw), chunk=97)) == data
    size = 8 + int.from_bytes(raw[4:8], "little")
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8:size]))
    assert zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(raw[size:]) == data[0]  # each record by itself
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(raw[:-5])))
    with pytest.raises(ValueError):
        warc.parsed(data[0].replace(b"page", b"pagx"))


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randrange(1, 60)), r.choice(["a", "b", "b", "b", "c", None])) for i in range(600)] + [(700, None, "a"), (None, "x y", "b"), (701, "", "empty")]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, size int")
    plan = mixing_plan(docs).collect()
    sizes, total = {}, 0
    for x in plan:
        sizes[x.source] = sizes.get(x.source, 0) + x.size
        total += x.size
    # The shares by repeated division, as the rule says it.
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, open_ = {}, set(sizes)
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] >= 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    target |= {s: level * weights[s] for s in open_}
    taken = {}
    for x in plan:
        assert x.source_size == sizes[x.source] and abs(x.target - target[x.source]) < 1e-6 and 0 <= x.copies <= 3
        rate = x.target / x.source_size if x.source_size else 0
        assert x.copies in (int(rate), int(rate) + 1)
        taken[x.source] = taken.get(x.source, 0) + x.copies * x.size
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.02 * t + 5
    again = mixing_plan(docs.repartition(7)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))
    mix = mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(x.copies for x in plan)
    assert mixed(docs.where("doc_id < 0")).count() == 0


def test_codewords():
    for n in (2, 3, 4, 6, 9, 20):
        c = codewords(n)
        assert c.shape[0] == n and len({tuple(x) for x in c}) == n
        columns = {tuple(x * x[0]) for x in c.T}
        assert len(columns) == c.shape[1]


def test_language(spark):
    r = random.Random(4)
    say = {"aa": ["foo", "bar", "bazzle"], "bb": ["über", "schön", "lied"], "cc": ["qué", "niño", "hola"]}
    rows = [(i, " ".join(r.choice(say[k]) for _ in range(30)), k) for i in range(300) for k in [r.choice(list(say))]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", "cc"), (None, "foo bar bazzle foo", None), (903, "niño hola qué niño", None)]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double")
    got = language_id(docs).collect()
    by_id = {x.doc_id: x for x in got}
    assert all(by_id[i].lang_pred == "und" for i in (900, 901, 902)) and by_id[None].lang_pred == "aa" and by_id[903].lang_pred == "cc"
    tested = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 300]
    truth = {d: k for d, _, k in rows}
    assert tested and all(x.lang_pred == truth[x.doc_id] for x in tested) and all(0 <= x.score <= 1 for x in got)
    kept = accepted(docs)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {d for d, *_ in rows} - {900, 901, 902}
    assert language_id(docs.where("doc_id < 0")).count() == 0
    assert LanguageModel.fitted({}).predict(pa.array(["a", None]))[0].tolist() == [-1, -1]


def test_decontamination(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(6, 60)))) for i in range(60)] + [(90, None), (91, ""), (92, "two words")]
    rows, want = [], {}
    for i in range(200):
        words = [r.choice(vocabulary) for _ in range(r.randrange(400))]
        if i % 4 == 0:
            k = r.randrange(60)
            at = r.randrange(len(words) + 1)
            words[at:at] = items[k][1].upper().replace(" ", ", ").split(" ")
            want[i] = k
        if i % 4 == 1:
            k = r.randrange(60)
            words += items[k][1].split()[: len(items[k][1].split()) // 2]  # the question without the answer
        rows.append((i, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "some two words here"), (None, items[3][1])]
    docs = spark.createDataFrame([(*x, [1]) for x in rows], "doc_id long, text string, item_ids array<int>")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: x.item_ids for x in flagged(docs, bench).collect()}
    for i, _ in rows[:200]:
        assert (want[i] in got[i]) if i in want else (got[i] == []), i
    assert got[300] == got[301] == [] and got[302] == [92] and got[None] == [3]
    left = decontaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not v for v in got.values())
    assert decontaminated(docs, bench.where("item_id < 0")).count() == len(rows)
    pairs = {(x.doc_id, x.item_id) for x in contamination(docs, bench).collect()}
    assert pairs == {(d, i) for d, v in got.items() for i in v}


def plain_matches(texts, items):
    """Row and item of each match, by scoring every passage against every item, and comparing runs of words as tuples."""

    def words(text):
        return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def runs(w, size):
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}

    own = [words(x) for x in items]
    n, mean = sum(bool(w) for w in own), sum(map(len, own)) / len(own)
    df = Counter(t for w in own for t in set(w))

    def score(present, k):
        tf = Counter(own[k])
        return sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * (decon.K1 + 1) / (f + decon.K1 * (1 - decon.B + decon.B * len(own[k]) / mean)) for t, f in tf.items() if t in present)

    parts = []
    for w in own:
        cut = len(w) - len(w) // 3
        each = (w, w[:cut], w[cut:]) if len(w) >= 2 * decon.SHINGLE and 0 < cut < len(w) else (w, w, w)
        parts.append([runs(p, min(decon.SHINGLE, len(p))) for p in each] if w else [])
    for row, text in enumerate(texts):
        whole = words(text)
        for k, w in enumerate(own):
            stride = decon.LEAST_STRIDE
            while stride < len(w):
                stride *= 2
            for at in range(0, max(1, len(whole) - stride), stride) if w and whole else ():
                passage = whole[at : at + 2 * stride]
                if score(set(passage), k) >= decon.SHARE * score(set(w), k):
                    shares = [len(p & runs(passage, len(next(iter(p))))) / len(p) for p in parts[k]]
                    if shares[0] >= decon.OVERLAP and min(shares) >= decon.PART_OVERLAP:
                        yield row, k


@pytest.mark.parametrize("lookups", [1 << 21, 1])
def test_decontamination_by_brute_force(spark, monkeypatch, lookups):
    monkeypatch.setattr(decon, "LOOKUPS", lookups)
    monkeypatch.setattr(decon, "TABLE", lookups - 1)
    r = random.Random(6)
    vocabulary = [f"t{i}" for i in range(150)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.choice([1, 4, 9, 20, 33, 64, 65, 200]))) for _ in range(80)] + [None, " ."]
    texts = [None, "", "t1", *items[:8]]
    for _ in range(150):
        w = [r.choice(vocabulary) for _ in range(r.randrange(300))]
        for _ in range(r.randrange(3)):
            part = (r.choice(items) or "").split()
            for _ in range(r.randrange(1 + len(part) // 8)):
                part[r.randrange(len(part))] = "other"
            at = r.randrange(len(w) + 1)
            w[at:at] = part[: r.choice([len(part), len(part), 1 + len(part) // 2])]
        texts.append(" ".join(w))
    index = ItemIndex(list(range(len(items))), items)
    got = {m[:2] for m in index.matches(pa.array(texts, pa.string()))}
    want = set(plain_matches(texts, items))
    assert got == want and len(want) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(x.doc_id, k) for x in flagged(docs, bench).collect() for k in x.item_ids} == want


def test_index_size():
    r = random.Random(7)
    items = [" ".join(f"word{r.randrange(50_000)}" for _ in range(50)) for _ in range(3000)]
    size = sum(map(len, items)) + 64 * len(items)
    assert ItemIndex(list(range(3000)), items).nbytes <= 16 * size

