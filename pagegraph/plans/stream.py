"""The event table as a stream of model calls, taken until it ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegraph.plans.shapes import CALLS
from pagegraph.streaming.costs import run_available, running_cost


def shared_home(spark: SparkSession) -> str:
    """The folder that all executors see; one made here only where everything runs in one machine."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    return (known or tempfile.mkdtemp(prefix="pagegraph-")).rstrip("/")


def streamed_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch writes its changed totals; the last ones of each day and stage are the result."""
    home = f"{shared_home(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    totals = running_cost(spark.sql(CALLS, events=events))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{home}/out/batch={number}")

    run_available(totals, keep, f"{home}/state")
    rows = spark.read.parquet(f"{home}/out")
    newest = rows.groupBy("day", "stage").agg(F.max_by(F.struct("calls", "input_tokens", "output_tokens"), "batch").alias("x"))
    return newest.select("day", "stage", "x.*")
