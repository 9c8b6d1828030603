"""What model calls cost, at several grains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Model, dollars for a million input, output and cached input tokens, in the order in which prefixes are tried.
PRICES = (
    ("gemini-3-flash-preview", 0.50, 3.00, None),
    ("gemini-2.5-flash-lite", 0.10, 0.40, None),
    ("gemini-2.5-flash", 0.30, 2.50, None),
    ("gemini-2.5-pro", 1.25, 10.0, None),
    ("gemini-2.0-flash", 0.10, 0.40, None),
    ("gemini-1.5-flash", 0.075, 0.30, None),
    ("gemini-1.5-pro", 1.25, 5.00, None),
    ("gpt-4.1", 2.00, 8.00, 0.50),
    ("gpt-4.1-mini", 0.40, 1.60, 0.10),
    ("gpt-4.1-nano", 0.10, 0.40, 0.025),
    ("gpt-4o", 2.50, 10.0, 1.25),
    ("gpt-4o-mini", 0.15, 0.60, 0.075),
    ("gpt-5", 5.00, 15.00, None),
    ("gpt-5.2", 8.00, 24.00, None),
    ("o1", 15.00, 60.00, None),
    ("o1-mini", 3.00, 12.00, None),
    ("o3-mini", 1.10, 4.40, None),
)
MILLION = 1_000_000


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(k, *row) for k, row in enumerate(PRICES)]
    return spark.createDataFrame(rows, "ordinal int, key string, input double, output double, cached double")


def with_prices(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with the price of their model: its own, else that of the first key that its name starts with; none is free.

    Prices are looked up once for each distinct model; the table of prices is a short list and is broadcast.
    """
    models = calls.select("model").distinct()
    exact = F.lower("model") == F.col("key")
    found = models.join(F.broadcast(prices), F.lower("model").startswith(F.col("key")), "left")
    best = found.groupBy("model").agg(F.min_by(F.struct("input", "output", "cached"), F.struct((~exact).alias("other"), "ordinal")).alias("price"))
    return calls.join(best, calls["model"].eqNullSafe(best["model"])).drop(best["model"])


def call_cost() -> Column:
    """Dollars of a call; cached tokens are free where no price for them is listed."""
    price = F.col("price")
    paid = (F.col("input_tokens") - F.col("cached_tokens")) * price["input"] + F.col("output_tokens") * price["output"] + F.col("cached_tokens") * F.coalesce(price["cached"], F.lit(0.0))
    return F.greatest(F.lit(0.0), F.coalesce(paid, F.lit(0.0)) / MILLION)


def call_nano() -> Column:
    """The same in whole billionths of a dollar, in which every listed price for one token is a whole number, so sums are exact."""
    price = F.col("price")

    def milli(name: str) -> Column:
        return F.coalesce(F.round(price[name] * 1000).cast("bigint"), F.lit(0))

    return F.greatest(F.lit(0).cast("bigint"), (F.col("input_tokens") - F.col("cached_tokens")) * milli("input") + F.col("output_tokens") * milli("output") + F.col("cached_tokens") * milli("cached"))


def cost_summary(calls: DataFrame) -> DataFrame:
    """Calls, tokens and dollars in all, by stage, and by provider and model, in one pass.

    Tokens are added up per model before any price is applied, so sums are exact and the same in any order.
    """
    totals = calls.groupBy("stage", "provider", "model", "price").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cached_tokens")])
    priced = totals.withColumn("nano", call_nano())
    grains = priced.groupingSets([[], ["stage"], ["provider", "model"]], "stage", "provider", "model")
    return grains.agg(F.grouping_id("stage", "provider", "model").cast("int").alias("grain"), *[F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens", "cached_tokens")], (_div(F.sum("nano") + 500, 1000) / MILLION).alias("usd"))


def _div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / b).cast("bigint")


def weekly_spend(jobs: DataFrame, ts: str, amount: Column) -> DataFrame:
    """Calls and amount by week, which begins on Monday."""
    return jobs.groupBy(F.date_trunc("week", ts).cast("date").cast("string").alias("week")).agg(F.count("*").alias("calls"), F.sum(amount).alias("amount"))


def call_pairs(log: DataFrame, keys: list[str]) -> DataFrame:
    """First place, last input and last output of each group of a log of inputs and outputs."""
    def last(direction: str) -> Column:
        own = F.col("direction") == direction
        return F.max_by(F.when(own, F.col("entry")), F.when(own, F.col("seq")))

    return log.groupBy(*keys).agg(F.min("seq").alias("first_seq"), last("input").alias("last_input"), last("output").alias("last_output"))
