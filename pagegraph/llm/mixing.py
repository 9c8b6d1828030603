"""Mixing sources to target weights: whole copies by rate, and one more by a seeded draw.

The tokens of each source give its target; target over tokens is its rate. Every document is emitted
floor(rate) times, and once more where a hash of its doc_id falls below the rate's fraction. The hash gives
each document one number; ``draws`` shifts of it are as many draws, and each source takes the draw whose
total comes nearest its target, so that small sources are met as well. (Choosing among draws means that in a source of
very few documents the chance of one more copy is not quite the fraction; with ``draws`` 1 it is.) Reruns agree: a draw
depends on nothing but the doc_id.

Targets: the sources, in order of their code points and null last, weigh ``weights`` over and over, and share
all tokens. A target stops at ``most`` times its source's tokens; what is over is shared again by weight, in rounds:
each is an aggregate over the sources, of which the next stops those that its level lifts above their limits. There
are at most as many rounds as sources that stop one after the other, in practice a few.

Edge cases: a null text has no tokens; sources without tokens get target 0; a null source is a source; a null
doc_id draws as the empty text; repeated rows draw alike; an empty table gives an empty result. Other columns
are kept by ``mixed`` and ignored by ``mixing_plan``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegraph.llm._shared import WORD, cut, text_of

WEIGHTS = (1, 2, 3)
MOST = 3
DRAWS = 32
SEED = "mix"
#: Draws are integers below SPACE; one draw's shift against the one before is STEP, near SPACE over the golden ratio.
SPACE = 1 << 48
STEP = 173_961_102_589_771


def size_of(text: str = "text") -> Column:
    """The number of words."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def draw_of(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number from 0 to SPACE - 1 that depends on doc_id and seed only."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint")


def ordinal(sources: DataFrame) -> DataFrame:
    """``rank``, from 0, of each row by its column source, null last, without one task that sees all rows.

    Rows are dealt out by range and counted in each; the few counts give each range its first rank.
    """
    dealt = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = cut(dealt)
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    first = counts.withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("within", within).join(F.broadcast(first), "part").withColumn("rank", (F.col("first") + F.col("within")).cast("bigint")).drop("part", "within", "first")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size and target from rows of source and size."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    ranked = cut(ordinal(sources).select("source", "source_size", w.alias("weight"), (F.col("source_size") * most).alias("limit")))
    capped, level = F.lit(False), None
    total, stopped = None, -1
    while True:
        # Each round adds the sources that the level of the round before lifts above their limits.
        row = ranked.select(
            F.sum("source_size").alias("total"), F.sum(F.when(capped, F.col("limit")).otherwise(0)).alias("held"),
            F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("rest"), F.count_if(capped).alias("stopped"),
        ).first()
        if not row.total or not row.rest or row.stopped == stopped:
            break
        total, stopped = row.total, row.stopped
        level = (float(total - row.held), float(row.rest))
        capped = F.col("limit") <= F.lit(level[0]) / F.lit(level[1]) * F.col("weight")
    if level is None:
        return ranked.select("source", "source_size", F.lit(0.0).alias("target"))
    shared = F.lit(level[0]) / F.lit(level[1]) * F.col("weight")
    return ranked.select("source", "source_size", F.when(capped, F.col("limit").cast("double")).otherwise(shared).alias("target"))


def _extra(draw: Column, k: Column, below: Column) -> Column:
    """1 where draw k falls below the fraction, else 0."""
    return (F.pmod(draw + k * F.lit(STEP), F.lit(SPACE)) < below).cast("int")


def _with(rows: DataFrame, of_source: DataFrame) -> DataFrame:
    """rows with what their sources have; a null source is a source."""
    of_source = of_source.withColumnRenamed("source", "_source")
    return rows.join(of_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def choices(rows: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, draws: int = DRAWS) -> DataFrame:
    """source, source_size, target, whole (copies that all get), below and best (the draw for one more) from rows of source, size and draw."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = targets(rows, weights, most).withColumn("whole", F.floor(rate)).withColumn("below", F.floor((rate - F.col("whole")) * SPACE))
    taken = [F.sum((F.col("whole") + _extra(F.col("draw"), F.lit(k), F.col("below"))) * F.col("size")).alias(f"t{k}") for k in range(draws)]
    sums = _with(rows, goal).groupBy("source").agg(*taken)
    off = F.array(*[F.abs(F.col(f"t{k}") - F.col("target")) for k in range(draws)])
    return cut(_with(goal, sums).select("source", "source_size", "target", "whole", "below", (F.array_position(off, F.array_min(off)) - 1).alias("best")))


def _copies(most: int) -> Column:
    return F.least(F.col("whole") + _extra(F.col("draw"), F.col("best"), F.col("below")), F.lit(most)).cast("int")


def mixing_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, draws: int = DRAWS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and copies (how often it is emitted) of every row of docs."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), draw_of(doc_id, seed).alias("draw")))
    planned = _with(rows, choices(rows, weights, most, draws))
    return planned.select("doc_id", "source", "size", "source_size", "target", _copies(most).alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, most: int = MOST, draws: int = DRAWS, seed: str = SEED) -> DataFrame:
    """The mix itself: every row of docs as often as the plan says, with all its columns."""
    light = cut(docs.select(F.col(source).alias("source"), size_of(text).alias("size"), draw_of(doc_id, seed).alias("draw")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(source).alias("source"), draw_of(doc_id, seed).alias("draw"))
    planned = _with(rows, choices(light, weights, most, draws)).withColumn("copies", _copies(most))
    return planned.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
