"""The running cost of model calls, as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def calls_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_cost(calls: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Calls and tokens by day and stage. Days that end before the watermark leave the state, so it stays bounded."""
    return calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "stage").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "stage", "calls", "input_tokens", "output_tokens")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Hands all that has come to the sink, batch by batch, and ends; a restart goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def transitions(states: DataFrame) -> DataFrame:
    """Rows at which a job's status differs from the one before."""
    before = F.lag("status").over(Window.partitionBy("job_id").orderBy("ts", "seq"))
    return states.withColumn("before", before).where("before is not null and before <> status")
