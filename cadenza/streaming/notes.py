"""Structured Streaming over event files: windowed counts with late data, and a recursive filter per piece as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files in a folder; ts becomes a timestamp that watermarks accept."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option(
        "maxFilesPerTrigger", files_per_trigger
    ).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """(window, event_type, n, total): tumbling counts; rows later than the watermark are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(session_window, user_id, n): stretches of a user's events without a longer gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def kalman(events: DataFrame, process_var: float = 0.01, measure_var: float = 0.1) -> DataFrame:
    """(user_id, level, variance, n): a scalar filter over each user's values in order of arrival, whose state lives on between batches."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        level, variance, n = state.get if state.exists else (None, 1.0, 0)
        for frame in frames:
            for x in frame.sort_values(["ts", "event_id"])["value"]:
                if level is None:
                    level = float(x)
                else:
                    gain = (variance + process_var) / (variance + process_var + measure_var)
                    level, variance = level + gain * (x - level), (1 - gain) * (variance + process_var)
                n += 1
        state.update((level, variance, n))
        yield pd.DataFrame([[key[0], level, variance, n]], columns=["user_id", "level", "variance", "n"])

    schema = "user_id bigint, level double, variance double, n bigint"
    return events.groupBy("user_id").applyInPandasWithState(run, schema, "level double, variance double, n bigint", "update", "NoTimeout")


def run_to_end(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """What a stream gives once it has read all that is there: each batch writes the whole result, open windows included, and the last one is
    read back.
    """
    spark, name = stream.sparkSession, f"cadenza_{checkpoint.rpartition('-')[2]}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(folder)

    query = stream.writeStream.queryName(name).outputMode("complete").trigger(availableNow=True).option(
        "checkpointLocation", checkpoint
    ).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(folder)
