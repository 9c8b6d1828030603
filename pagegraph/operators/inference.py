"""Model calls as an operator: a client behind a protocol, prompts as rows, errors as a column.

The engine never calls a service by itself; the default client answers from the prompt alone, the same every time.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from pagegraph.functions.dates import display_date
from pagegraph.functions.fuzzy import sequence_ratio
from pagegraph.functions.names import clean_title, format_author
from pagegraph.functions.wording import kind_label, scrub_opinion

# Tries of a call, and the longest pause between them, in seconds.
TRIES, LONGEST_PAUSE = 5, 60

# Phrases of labels that route a document rather than describe it, and how alike a long word has to be.
ROUTING = ("ordering", "deliver to", "delivered to", "family physician", "admitting", "consulting", "referred by", "referring", "provider", "copy to", "copies to", "cc", "attention", "attn", "addressed to", "requested by")
SAME_WORD, SHORT_WORD = 0.9, 4

# Fixed value: characters of a whole text that go into a prompt.
FULL_TEXT = 12000


class InferenceClient(Protocol):
    """What the operator asks of a client; it must be picklable."""

    def complete(self, prompt: str) -> str:
        """The model's answer to a prompt, as a JSON object."""


class StubClient:
    """Answers with the digest and length of the prompt."""

    def complete(self, prompt: str) -> str:
        return json.dumps({"digest": hashlib.sha256(prompt.encode()).hexdigest(), "length": len(prompt)})


def pause_column(attempt: Column) -> Column:
    """The same for a column."""
    return F.least(F.lit(LONGEST_PAUSE), F.pow(F.lit(2), attempt)).cast("int")


def pause(attempt: int) -> int:
    """Seconds to wait after a failed try."""
    return min(LONGEST_PAUSE, 2**attempt)


#: What the four kinds of calls have to answer with (F09), as schemas of Spark; their fields are what an answer must have.
ANSWERS = {
    "pages": "pages array<struct<page_number:int,page_kind:string,document:struct<title:string,bucket:string,date:string,custom_type:string>,evidence:array<struct<kind:string,text:string,value:string,provenance:string>>>>",
    "identities": "clusters array<struct<canonical:string,members:array<string>>>",
    "summaries": "units array<struct<unit_id:string,text:string>>",
    "opinion": "header map<string,string>, definition string, opinion string",
}


def required_fields(kind: str) -> tuple[str, ...]:
    """The fields that an answer of this kind must have."""
    return tuple(StructType.fromDDL(ANSWERS[kind]).fieldNames())


def checked_answer(answer: str, required: Sequence[str]) -> str:
    """The answer, if it is a JSON object with the required fields."""
    value = json.loads(answer)
    if not isinstance(value, dict):
        raise ValueError("the answer is not a JSON object")
    lost = [f for f in required if f not in value]
    if lost:
        raise ValueError(f"the answer lacks {', '.join(lost)}")
    return answer


def infer(rows: DataFrame, prompt: str, client: InferenceClient | None = None, tries: int = TRIES, wait: Callable[[float], None] = time.sleep, required: Sequence[str] = ()) -> DataFrame:
    """rows with answer and error (F01-F05): a call that fails for good leaves null and says why, and the others go on.

    An answer without the required fields is a failed try.
    """
    model = client or StubClient()
    needed = tuple(required)

    def ask(text: str | None) -> tuple[str | None, str | None]:
        for attempt in range(tries):
            try:
                return (None, None) if text is None else (checked_answer(model.complete(text), needed), None)
            except Exception as e:  # noqa: BLE001  whatever a client raises is this row's error
                failed = f"{type(e).__name__}: {e}"[:200]
                if attempt < tries - 1:
                    wait(pause(attempt))
        return None, failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [ask(t) for t in batch.column(prompt).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([a for a, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], [*batch.schema.names, "answer", "error"])

    return rows.mapInArrow(run, type(rows.schema)([*rows.schema.fields]).add("answer", "string").add("error", "string"))


def prompts_of(rules: DataFrame, head: str) -> DataFrame:
    """One prompt for each configuration: the head, then a line for each rule in order."""
    lines = F.array_sort(F.collect_list(F.struct("sort_order", "rule_id", F.concat(F.lit("- "), "document_type", F.lit(": "), "action").alias("line"))))
    return rules.groupBy("config_id").agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("prompt"))


def answers_or_fallback(units: DataFrame, answers: DataFrame) -> DataFrame:
    """text of each unit: the answer; the fallback where there is none, or an empty one among several; a lone unit with an empty answer goes."""
    joined = units.join(answers, "unit_id", "left")
    alone = F.count("*").over(Window.partitionBy("chunk_id")) == 1
    return joined.withColumn("_alone", alone).where(~(F.col("_alone") & F.coalesce(F.trim("answer") == "", F.lit(False)))).withColumn("text", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), "fallback")).drop("_alone", "answer")


def distinct_evidence(evidence: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first of evidence with the same kind and text, without regard to case."""
    return evidence.groupBy(*keys, "kind", F.lower("text").alias("_k")).agg(F.min_by(F.struct(*[c for c in evidence.columns if c not in (*keys, "kind")]), order).alias("e")).select(*keys, "kind", "e.*")


def with_routing(fields: DataFrame, label: str = "label") -> DataFrame:
    """fields with routing: whether the label has one of the routing phrases, give or take a slip in a long word.

    Each different label is judged once. Its words are runs of letters; each different long word is compared with the
    long words of the phrases once, and takes the place of the one that it is most like. A phrase is then found as text.
    """
    long = sorted({w for phrase in ROUTING for w in phrase.split() if len(w) > SHORT_WORD})
    words = F.filter(F.split(F.lower(F.col("_label")), "[^a-z]+"), lambda w: w != "")
    labels = fields.select(F.col(label).alias("_label")).where("_label is not null").distinct().select("_label", F.posexplode(words).alias("_at", "_word"))
    asked = labels.select("_word").distinct().select("_word", F.explode(F.array(*[F.lit(w) for w in long])).alias("_mark"))
    # Words whose lengths alone keep them apart are not compared.
    fits = F.least(F.length("_word"), F.length("_mark")) >= SAME_WORD / 2 * (F.length("_word") + F.length("_mark"))
    alike = asked.where((F.length("_word") > SHORT_WORD) & fits).withColumn("_ratio", sequence_ratio("_word", "_mark")).where(F.col("_ratio") >= SAME_WORD)
    stands = alike.groupBy("_word").agg(F.max_by("_mark", "_ratio").alias("_mark"))
    told = labels.join(stands, "_word", "left").groupBy("_label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_mark", "_word").alias("w")))), lambda x: x["w"]), " ").alias("_told"))
    routing = told.select("_label", F.col("_told").rlike(f"(?:^| )(?:{'|'.join(ROUTING)})(?: |$)").alias("routing"))
    return fields.join(routing, F.col(label) == F.col("_label"), "left").withColumn("routing", F.coalesce("routing", F.lit(False))).drop("_label")


def loggable(value: object) -> object:
    """A value for the log, with encoded content replaced by its length and digest."""
    if isinstance(value, dict):
        return {k: f"<{len(v)} characters, sha256 {hashlib.sha256(v.encode()).hexdigest()}>" if k == "base64" and isinstance(v, str) else loggable(v) for k, v in value.items()}
    return [loggable(v) for v in value] if isinstance(value, list) else value


def usage(raw: Column) -> dict[str, Column]:
    """Token counts from a service's answer in either of two forms, 0 where missing."""
    def first(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(raw, p).cast("bigint") for p in paths], F.lit(0).cast("bigint"))

    return {"input_tokens": first("$.usage.prompt_tokens", "$.usage.input_tokens"), "output_tokens": first("$.usage.completion_tokens", "$.usage.output_tokens"), "cached_tokens": first("$.usage.prompt_tokens_details.cached_tokens", "$.usage.input_tokens_details.cached_tokens")}


@F.pandas_udf(StringType())
def loggable_json(raw: pd.Series) -> pd.Series:
    """JSON for the log, as ``loggable`` has it (X02); what is not JSON stays."""
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(loggable(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return text

    return raw.map(one)


def identity_prompts(names: DataFrame) -> DataFrame:
    """One prompt for each file with two different names at least (F02); names: file_id, name, n."""
    listed = F.array_sort(F.collect_list(F.struct("name", "n")))
    files = names.groupBy("file_id").agg(listed.alias("names")).where(F.size("names") >= 2)
    return files.select("file_id", F.to_json(F.struct("names")).alias("prompt"))


def identity_clusters(answers: DataFrame) -> DataFrame:
    """cluster, canonical and members of each answer (F02), for ``linkage.rename_map``; a file whose call failed has none."""
    told = F.from_json("answer", ANSWERS["identities"])
    return answers.where("answer is not null").select("file_id", F.posexplode(told["clusters"]).alias("cluster", "c")).select("file_id", "cluster", F.trim("c.canonical").alias("canonical"), F.transform("c.members", lambda m: F.trim(m)).alias("members"))


def with_opinions(headers: DataFrame, answers: DataFrame, fields: Sequence[str], none: str = "No patient opinion generated.") -> DataFrame:
    """headers with definition and opinion; a field that the answer's header fills replaces what was read.

    Where the call failed, the header stays and the definition says so.
    """
    told = F.from_json("answer", ANSWERS["opinion"])
    joined = headers.join(answers.select("bundle_id", told.alias("_t")), "bundle_id", "left")
    corrected = {f: F.coalesce(F.nullif(F.trim(F.col("_t.header")[f]), F.lit("")), F.col(f)) for f in fields}
    said = F.when(F.col("_t").isNull(), F.lit(none)).otherwise(scrub_opinion(F.coalesce("_t.definition", F.lit(""))))
    opinion = scrub_opinion(F.coalesce("_t.opinion", F.lit("")))
    return joined.withColumns({**corrected, "definition": said, "opinion": opinion}).drop("_t")


def by_position(batches: DataFrame) -> DataFrame:
    """Pages of each batch with the entry at their place in the answer, whatever page it claims to be.

    batches: batch_id, pages (numbers) and entries (strings). A batch of several pages whose answer has another number
    of entries gives each page alone and no entry: again says that it has to be asked once more. A single page takes
    the first entry, or none.
    """
    several = F.size("pages") > 1
    again = several & (F.size("entries") != F.size("pages"))
    rows = batches.select("batch_id", again.alias("again"), "entries", F.posexplode("pages").alias("at", "page_number"))
    return rows.select("batch_id", "page_number", F.when(~F.col("again"), F.get("entries", F.col("at"))).alias("entry"), "again")


def unit_contexts(units: DataFrame) -> DataFrame:
    """What a summary's prompt has of each unit, as JSON (P13): a unit's own date and author, else its document's; whole text only where the rule asks for it.

    units: unit_id, sub_date, date, title, bucket, sub_author, author, claimant_authored, n_units, max_words, rule_type, rule_action, custom_type, markdown.
    """
    own = {
        "subsection_id": F.col("unit_id"), "date": F.coalesce(F.nullif(display_date(F.col("sub_date")), F.lit("")), display_date(F.col("date")), F.lit("")), "title": F.coalesce(clean_title(F.col("title")), F.lit("")),
        "label": kind_label(F.col("bucket")), "document_bucket": F.col("bucket"), "author": F.coalesce(format_author(F.coalesce(F.nullif("sub_author", F.lit("")), F.col("author")), F.lit(False), F.lit(None).cast("string")), F.lit("")),
        "claimant_authored": F.coalesce("claimant_authored", F.lit(False)), "is_multi_unit_document": F.col("n_units") > 1, "maximum_words": F.col("max_words"),
        "rule_document_type": F.coalesce("rule_type", F.nullif("custom_type", F.lit("")), "bucket"), "full_text": F.when(F.col("rule_action") == "full_data", F.nullif(F.left(F.trim("markdown"), F.lit(FULL_TEXT)), F.lit(""))),
    }
    return units.select("unit_id", F.to_json(F.struct(*[v.alias(k) for k, v in own.items()])).alias("context"))
