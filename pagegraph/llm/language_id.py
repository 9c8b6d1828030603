"""Language ID by error-correcting output codes.

Every learned language has a codeword of bits. For each bit there is a binary classifier, a log-odds weight for
each hashed byte trigram, that tells the languages with a 1 from those with a 0. A text's margin for a bit is the
mean weight of its trigrams, in units of what the bit's two sides have in training. Decoding adds up, over the
bits, the logistic loss of the margin against each codeword, weighted by how far apart the bit's two sides are,
and takes the codeword of least loss. The score is the softmax of the negative losses; a text whose two best
codewords are closer than ``AMBIGUOUS`` in it is flagged.

Learning uses text and lang of labelled rows that are not held out, at most about ``PER_LANGUAGE`` of each
language, drawn by a hash of doc_id; their trigrams are counted on the executors, and languages times ``BUCKETS``
counts reach the driver. Prediction reads whole texts and uses nothing else of a row.

Edge cases: a text that is null or has no letter is ``und`` with score 1; so is every text, with score 0, if no
row is labelled; with one language, it is predicted for every text with letters. A null doc_id counts as the
empty text in the hash. Repeated rows each get their result; an empty table gives an empty one; other columns
pass through ``with_language``, and those named like its columns are replaced.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegraph.llm._bytes import buffer_of, slices
from pagegraph.llm._shared import given_back, small

FOLDS = 5
BUCKET_BITS = 13
BUCKETS = 1 << BUCKET_BITS
#: Rows of a language that are learned from, about; the bound of the sample.
PER_LANGUAGE = 20_000
#: Languages that may be learned; their counts, BUCKETS of each, come to the driver, and more is an error.
MOST_LANGUAGES = 500
#: Gap between the two best scores below which a text is flagged.
AMBIGUOUS = 0.2
#: Score below which ``accepted`` rejects a text: a text in equal parts of two languages has about half for each.
REJECTED = 0.4
#: Added to each count; steepness of the softmax.
SMOOTH, STEEP = 0.5, 6.0
UNDETERMINED = "und"
#: Languages up to which all splits of them into two sides are bits; beyond, bits are drawn by a fixed rule.
EXHAUSTIVE = 6

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(65), *range(91, 97), *range(123, 128)]] = 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = True


def held_out(doc_id: str = "doc_id", folds: int = FOLDS) -> Column:
    """Whether a row is kept from learning."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 for each of n languages; rows differ, and no two columns split the languages alike."""
    if n <= EXHAUSTIVE:
        rows = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(rows, np.int8).T.reshape(n, -1)
    bits, made, k = 10 * math.ceil(math.log2(n)), [], 0
    draw = np.random.default_rng(n)
    while len(made) < bits or len(np.unique(np.array(made), axis=1).T) < n:
        column = draw.permutation(np.where(np.arange(n) < n // 2, 1, -1))
        k += 1
        if not any(abs(int(column @ m)) == n for m in made):
            made.append(column)
    return np.array(made, np.int8).T


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all texts on end, and the first of each text; a text has a blank around it."""
    before, after, nothing = (pa.scalar(x, pa.large_string()) for x in (" ", "  ", ""))
    around = pc.binary_join_element_wise(before, pc.fill_null(texts.cast(pa.large_string()), ""), after, nothing)
    buf, offs = buffer_of(around)
    b = _FOLD[buf].astype(np.uint32)
    value = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    bucket = ((value * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)
    keep = np.ones(len(buf), bool)
    keep[offs[1:] - 1] = keep[offs[1:] - 2] = False
    return bucket[keep[:-2]], offs[:-1] - 2 * np.arange(len(texts))


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    buf, offs = buffer_of(texts)
    upto = np.concatenate([[0], np.cumsum(_IS_LETTER[buf])])
    found = upto[offs[1:]] > upto[offs[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offs) > 0)).tolist():
        found[i] = any(c.isalpha() for c in texts[i].as_py())
    return found


@dataclass
class LanguageModel:
    """Languages, their codewords, and weights (bucket, bit), reach and trust of each bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    reach: np.ndarray
    trust: np.ndarray

    @classmethod
    def fitted(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        """From trigram counts of each language, BUCKETS of them."""
        languages = sorted(counts)
        codes = codewords(len(languages)) if len(languages) > 1 else np.ones((len(languages), 0), np.int8)
        share = np.array([(counts[x] + SMOOTH) / (counts[x] + SMOOTH).sum() for x in languages]).reshape(-1, BUCKETS)
        bits = codes.shape[1]
        weights, reach, trust = np.zeros((BUCKETS, bits), np.float32), np.ones(bits), np.ones(bits)
        for b in range(bits):
            one = codes[:, b] > 0
            weights[:, b] = np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))
            own = codes[:, b] * (share @ weights[:, b])  # the mean margin of each language, on its side
            reach[b], trust[b] = max(own.mean(), 1e-6), max(own.min(), 1e-6)
        return cls(languages, codes, weights, reach, trust / trust.sum() if bits else trust)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: undetermined), score, and whether it is ambiguous."""
        parts = [self._slice(texts.slice(a, b - a)) for a, b in slices(texts)] or [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(texts)
        letters = has_letter(texts)
        if not self.languages:
            return np.full(n, -1), np.where(letters, 0.0, 1.0), letters
        loss = np.zeros((n, len(self.languages)))
        bucket, first = trigrams(texts)
        size = np.diff(np.append(first, len(bucket)))
        for b in range(self.codes.shape[1]):
            mean = np.add.reduceat(self.weights[:, b][bucket].astype(np.float64), first) / size
            margin = (mean / self.reach[b])[:, None] * self.codes[:, b]
            loss += self.trust[b] * np.logaddexp(0, -2 * margin)
        share = np.exp(STEEP * (loss.min(axis=1, keepdims=True) - loss))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        ranked = np.sort(share, axis=1)
        gap = ranked[:, -1] - (ranked[:, -2] if ranked.shape[1] > 1 else 0)
        return np.where(letters, best, -1), np.where(letters, ranked[:, -1], 1.0), (gap < AMBIGUOUS) & letters


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fits a model on the labelled rows that are not held out."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & ~held_out("doc_id"))
    n = rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(small(share), "lang").where(draw < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            for one in set(langs):
                texts = batch.column(1).filter(pa.array(langs == one))
                for a, b in slices(texts):
                    total[one] = total.get(one, 0) + np.bincount(trigrams(texts.slice(a, b - a))[0], minlength=BUCKETS)
        for one, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    found = chosen.mapInArrow(lambda b: given_back(count(b)), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for one, part in found.groupby("lang"):
        counts[one] = np.zeros(BUCKETS)
        counts[one][part.bucket.to_numpy()] = part.n.to_numpy()
    return LanguageModel.fitted(counts)


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("lang_pred", "score", "ambiguous")]
    rows = docs.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{f.name}`") for f in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = pa.array([*known.languages, UNDETERMINED])
        for batch in batches:
            best, score, doubt = known.predict(batch.column(0))
            called = names.take(pa.array(np.where(best < 0, len(known.languages), best)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], called, pa.array(score), pa.array(doubt)], [*batch.schema.names[1:], "lang_pred", "score", "ambiguous"])

    schema = type(docs.schema)([*kept]).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return rows.mapInArrow(lambda b: given_back(run(b)), schema)


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from docs and gives doc_id, held_out, lang_pred, score and ambiguous of every row."""
    model = learn(docs, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return with_language(rows, model).drop("text")


def accepted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs whose language is known: not undetermined, and with a score of REJECTED at least."""
    rows = with_language(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_whole")), learn(docs, doc_id, text, lang), "_whole")
    return rows.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= REJECTED)).select("_row.*")
