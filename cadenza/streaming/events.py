"""Streams in append mode: state that the watermark drops, late rows by name, timers, and a join of two streams.

A stream here is a folder to which files come in arrivals. Each arrival is read to its end (trigger availableNow) and the query then stops; the next
one goes on from its checkpoint, so every step of a run is also a recovery. Results are appended once and never written again: what is open
stays in state until the watermark (the latest event time seen, less the allowed delay) has passed it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.storage import new_folder

_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def source(spark: SparkSession, folder: str, schema: Any) -> DataFrame:
    """The stream of a folder's files."""
    return spark.readStream.schema(schema).parquet(folder)


def run_arrivals(spark: SparkSession, arrivals: list[DataFrame], make: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """What a stream has appended after all arrivals. ``make`` builds the query from the stream of their rows."""
    landing, out, checkpoint = (new_folder(spark) for _ in range(3))
    schema = arrivals[0].schema
    before = spark.conf.get(_ROCKS[0])
    spark.conf.set(*_ROCKS)
    try:
        result = None
        for rows in arrivals:
            rows.write.mode("append").parquet(landing)
            result = make(source(spark, landing, schema))
            query = result.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint)
            query.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(result.schema).parquet(out)
    finally:
        spark.conf.set(_ROCKS[0], before)


def hourly(events: DataFrame, late: str) -> DataFrame:
    """(hour, event_type, n, total): counts of each hour that the watermark has passed; rows of such hours that come after that are left out."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.unix_seconds("window.start").alias("hour"), "event_type", "n", "total"
    )


def late_rows(arrivals: list[DataFrame], delay_seconds: int, width_seconds: int = 3600) -> DataFrame:
    """The rows that a windowed count in append mode leaves out, with the arrival they came in: their window ends by the watermark of the
    arrivals before, which is known in whole milliseconds.
    """
    out, watermark = [], None
    for k, rows in enumerate(arrivals):
        ends = (F.floor(F.unix_seconds("ts") / width_seconds) + 1) * width_seconds * 1000
        late = ends <= watermark if watermark is not None else F.lit(False)
        out.append(rows.where(late).withColumn("arrival", F.lit(k)))
        latest = rows.agg(F.max(F.unix_millis("ts"))).first()[0]
        if latest is not None:
            watermark = max(latest - delay_seconds * 1000, watermark or 0)
    union = out[0]
    for rows in out[1:]:
        union = union.unionByName(rows)
    return union


class _Levels(StatefulProcessor):
    """A scalar Kalman filter for each key. A timer, set anew by each row, reports the key's level once it has been silent, and drops its state."""

    def __init__(self, silence_ms: int, process_var: float, measure_var: float):
        self.silence_ms, self.process_var, self.measure_var = silence_ms, process_var, measure_var

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "level double, variance double, n bigint, last_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["ts_ms", "event_id"])
        level, variance, n, last = self.level.get() if self.level.exists() else (None, 1.0, 0, None)
        if last is not None:
            self.handle.deleteTimer(last + self.silence_ms)
        for x in frame["value"]:
            if level is None:
                level = float(x)
            else:
                gain = (variance + self.process_var) / (variance + self.process_var + self.measure_var)
                level, variance = level + gain * (x - level), (1 - gain) * (variance + self.process_var)
            n += 1
        last = max(last or 0, int(frame["ts_ms"].max()))
        self.level.update((level, variance, n, last))
        self.handle.registerTimer(last + self.silence_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        level, variance, n, last = self.level.get()
        self.level.clear()
        yield pd.DataFrame({"user_id": [key[0]], "level": [level], "variance": [variance], "n": [n], "last_ms": [last]})

    def close(self) -> None:
        pass


def levels(events: DataFrame, silence_seconds: int, late: str, process_var: float = 0.01, measure_var: float = 0.1) -> DataFrame:
    """(user_id, level, variance, n, last_ms): what each user's filter has come to when no event of the user has come for so long, by event time.
    State and timers are in RocksDB; a user that comes back begins anew.
    """
    rows = events.withColumn("ts_ms", F.unix_millis("ts")).withWatermark("ts", late)
    schema = "user_id bigint, level double, variance double, n bigint, last_ms bigint"
    return rows.groupBy("user_id").transformWithStateInPandas(_Levels(silence_seconds * 1000, process_var, measure_var), schema, "append", "EventTime")


def follows(first: DataFrame, second: DataFrame, keys: list[str], within: str, late: str) -> DataFrame:
    """Pairs of a row of each stream (ts, keys, and columns of different names) with equal keys, the second at most ``within`` after the first. Both
    sides are kept in state only as long as the watermark allows for a partner.
    """
    a = first.withColumnRenamed("ts", "first_ts").withWatermark("first_ts", late)
    b = second.withColumnsRenamed({"ts": "second_ts", **{k: f"_{k}" for k in keys}}).withWatermark("second_ts", late)
    match: Column = (F.col("second_ts") >= F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + F.expr(f"INTERVAL {within}"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, match).drop(*[f"_{k}" for k in keys])


def in_quarters(events: DataFrame, straggle: bool) -> list[DataFrame]:
    """Events in four arrivals by quarters of their time; with ``straggle`` one in fifty, by a hash of its id, comes with the last one."""
    ends = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    begin, end = ends["a"] or 0, (ends["b"] or 0) + 1
    quarter = F.expr(f"CAST((unix_micros(ts) - {begin}) * 4 DIV {end - begin} AS INT)")
    if straggle:
        quarter = F.when(F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 50 == 0, 3).otherwise(quarter)
    placed = events.withColumn("_quarter", quarter)
    return [placed.where(F.col("_quarter") == k).drop("_quarter") for k in range(4)]
