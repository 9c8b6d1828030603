"""Vectorised words, hashes, token ids and plane files against plain versions."""

import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash

from pagegraph.llm import bwt
from pagegraph.llm._bytes import shingles_of, words_of, xxh64
from pagegraph.llm._tokenize import FastEncoder
from pagegraph.llm.token_planes import PlaneReader, PlaneWriter, decode_file, ids_of, planes_of, token_planes, write_tokens

TEXTS = [None, "", "  ", "A", "a b", "\x0b x y\r\nz  ", "Ä ö" * 50, "one two three four five six seven", "x" * 200]


def test_words_shingles_and_hashes():
    words = words_of(pa.array(TEXTS), lower=True)
    start, end, count = shingles_of(words, 3)
    got, at = xxh64(words.data, start, end), 0
    for text, n in zip(TEXTS, count, strict=True):
        plain = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = [" ".join(plain[i : i + 3]) for i in range(len(plain) - 2)] or ([" ".join(plain)] if plain else [])
        assert [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles] == [int(x) for x in got[at : at + n]]
        at += n


def test_fast_encoder_is_the_library():
    encoder = FastEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(1)
    signs = list("ab s't're 've'll'dm  \n\t12é'ß!.'日😀\x1c\x85\xa0’") + ["'s", "'re", "  ", "\n\n", "<|endoftext|>"]
    texts = [None, "", " ", "\n", "'s", "'sfoo", "''s", " 's", "x'll've", "a  b", "a \n b  "] + ["".join(r.choice(signs) for _ in range(r.randrange(25))) for _ in range(3000)]
    ids, counts = (np.concatenate(c) for c in list(zip(*encoder.encode(pa.array(texts, pa.string())), strict=True))[2:])
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert encoder.library.encode(text or "", add_special_tokens=False).ids == ids[at : at + n].tolist()
        at += n


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint64).astype(np.uint32)
    assert (ids_of(planes_of(ids, mode), n, mode) == ids).all()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_plane_file_round_trip(mode):
    r = np.random.default_rng(3)
    docs = [r.integers(0, 50257, n).astype(np.uint32) for n in (0, 1, 5, 40, 3, 100)]
    out = io.BytesIO()
    writer = PlaneWriter(out, mode, block=16)
    for k, ids in enumerate(docs):
        writer.add(np.array([k]), np.array([k == 5]), np.array([len(ids)]), ids)
    writer.close()
    reader = PlaneReader(pa.BufferReader(out.getvalue()))
    got = [(d, ids.tolist()) for d, ids in reader.documents()]
    assert got == [(None if k == 5 else k, ids.tolist()) for k, ids in enumerate(docs)]
    with pytest.raises(ValueError):
        PlaneReader(pa.BufferReader(out.getvalue()[:-3]))


def test_token_planes(spark, tmp_path):
    texts = ["Hello there", None, "", "It's  fine\n", "日本"]
    docs = spark.createDataFrame([(i * 3 % 7, t) for i, t in enumerate(texts)] + [(None, "last")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = [tuple(r) for r in token_planes(docs, path, 2).collect()]
    library, start, want = FastEncoder(path).library, 0, []
    for doc_id, text in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is None, r[0])):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    files = write_tokens(docs, path, f"{tmp_path}/tokens", 2, mode="bit")
    assert sum(len(decode_file(r.path)) for r in files.collect()) == len(texts) + 1
    assert token_planes(docs.where("doc_id < 0"), path, 2).count() == 0


def test_merged_transforms_find_repeats():
    r = random.Random(3)
    for _ in range(150):
        step, depth = r.choice([1, 2, 3, 5]), r.choice([1, 2, 3, 8])
        strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(40))) for _ in range(r.randrange(1, 9))]
        strings += [strings[0][2:] + b"a", strings[-1]]
        data = np.frombuffer(b"".join(strings), np.uint8)
        if len(data) < step:
            continue
        length = np.array([len(s) for s in strings])
        start = np.cumsum(length) - length
        names = np.concatenate([bwt.named(bwt.window_hashes(data, step)[0]), np.zeros(step, np.int64)])
        k = r.randrange(1, 4)
        shards = [bwt.shard_of(names, start[i::k], length[i::k], depth, step) for i in range(k) if len(start[i::k])]
        width, seen = step * depth, {}
        for a, s in zip(start.tolist(), strings, strict=True):
            for i in range(len(s) - width + 1):
                seen.setdefault(s[i : i + width], []).append(a + i)
        crashing = bwt.named(np.zeros(len(data) - step + 1, np.uint64), data, step)  # hashes that are all equal: the bytes are named
        assert (bwt.named(bwt.window_hashes(data, step)[0])[:, None] == bwt.named(bwt.window_hashes(data, step)[0])).tolist() == (crashing[:, None] == crashing).tolist()
        assert set(bwt.repeated(shards, depth).tolist()) == {p for places in seen.values() if len(places) > 1 for p in places}
