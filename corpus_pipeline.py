"""From documents to token files: language, near-duplicates, benchmark items, mix, token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the
docs of the next. All but the last keep the columns of ``documents``, and any others.

Edge cases, in every stage: a null text is an empty one (it has no language and goes in the first stage; near-duplicate,
blank texts are alike); a null doc_id or source is a value like any other; repeated rows are near-duplicates of each
other, and separate rows elsewhere; an empty table gives an empty result; other columns pass through, whatever they are
called. What the stages write stays in the shared folder until ``pagegraph.llm._shared.cleared`` is called.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagegraph.llm._shared import shared_path
from pagegraph.llm.decontaminate import decontaminated
from pagegraph.llm.language_id import accepted
from pagegraph.llm.mixing import mixed
from pagegraph.llm.near_groups import near_dedup
from pagegraph.llm.token_planes import token_planes

END_ID = 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; rejected: no letters, or no language with a score of REJECTED."""
    return accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near-duplicates (five words, similarity 0.8)."""
    return near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says: not at all, once, or several times."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the token files."""
    return token_planes(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The stages hash and classify in ways that SQL does not express; tests compare them with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
