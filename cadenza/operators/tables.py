"""Further table verbs: as-of joins, splits, samples, and functions in Python where SQL has none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_of(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: list[str], order: str, slice_seconds: int = 86_400
) -> DataFrame:
    """left, each row with ``columns`` of the last row of ``right`` with its key at or before its time (the greatest ``order`` of equal times),
    else nulls.

    Both sides are sorted together by (key, slice of time, time), with a running last value in each slice; what a slice ends with is carried into
    the next ones of its key by a window over slices, of which a key has few. So no task holds a key's whole history, and no row meets more
    than one other. Times that are not timestamps are numbers, and slices are so many of them.
    """
    none = [F.lit(None).cast(right.schema[c].dataType).alias(f"_{c}") for c in columns]
    seen = F.struct(*[F.col(f"_{c}") for c in columns])
    a = left.select(
        F.struct(*left.columns).alias("_row"), F.col(key).alias("_key"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"),
        F.lit(None).cast(right.schema[order].dataType).alias("_order"), *none
    )
    row = F.lit(None).cast(a.schema["_row"].dataType).alias("_row")
    b = right.select(
        row, F.col(key).alias("_key"), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), F.col(order).alias("_order"),
        *[F.col(c).alias(f"_{c}") for c in columns]
    )
    time = F.col("_time")
    number = F.unix_seconds(time.cast("timestamp")) if isinstance(left.schema[left_time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else time
    both = a.unionByName(b).withColumn("_slice", F.floor(number / slice_seconds))
    here = F.last(F.when(F.col("_side") == 0, seen), True)
    w = Window.partitionBy("_key", "_slice").orderBy("_time", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.where("_side = 0").groupBy("_key", "_slice").agg(F.max_by(seen, F.struct("_time", "_order")).alias("_end"))
    slices = both.select("_key", "_slice").distinct().join(ends, ["_key", "_slice"], "left")
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(F.col("_key").alias("_k"), F.col("_slice").alias("_s"), F.last("_end", True).over(before).alias("_carried"))
    met = both.withColumn("_here", here.over(w)).where("_side = 1")
    met = met.join(carried, F.col("_key").eqNullSafe(F.col("_k")) & F.col("_slice").eqNullSafe(F.col("_s")), "left").withColumn("_last", F.coalesce("_here", "_carried"))
    return met.select("_row.*", *[F.col("_last")[f"_{c}"].alias(c) for c in columns])


def hash_fraction(column: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from the MD5 of a value and a seed: the same on every engine and at every run."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), column.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def split(df: DataFrame, id_col: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: a random share of rows by their ids, which does not change when rows are added."""
    return df.withColumn("is_test", hash_fraction(F.col(id_col), seed) < test_share)


def shuffled_sample(df: DataFrame, by: str, id_col: str, rows: int, seed: int = 42) -> DataFrame:
    """``rows`` random rows of each group, by seeded hash."""
    order = Window.partitionBy(by).orderBy(hash_fraction(F.col(id_col), seed), id_col)
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= rows).drop("_k")


def geometric_mean(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, geometric_mean) by a grouped-aggregate function in Python, for measures that SQL lacks; rows of a group are in one task, so take
    what SQL has where it has it.
    """

    @F.pandas_udf("double")
    def mean(x: pd.Series) -> float:
        return float(np.exp(np.log(x).mean()))

    return df.groupBy(by).agg(mean(column).alias("geometric_mean"))


@F.udtf(returnType="position: int, a: int, b: int, c: int")
class _Triples:
    def eval(self, values: list[int]) -> Iterator[tuple[int, int, int, int]]:
        for k in range(len(values or []) - 2):
            yield k, *values[k : k + 3]


def triples(notes: DataFrame, column: str = "pitch") -> DataFrame:
    """(piece_id, position, a, b, c): runs of three values by a table function in Python, joined laterally to each piece's ordered values."""
    spark = notes.sparkSession
    spark.udtf.register("cadenza_triples", _Triples)
    values = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(column).cast("int").alias("x")))), lambda s: s["x"]).alias("v")
    return spark.sql("SELECT piece_id, t.* FROM {pieces}, LATERAL cadenza_triples(v) AS t", pieces=notes.groupBy("piece_id").agg(values))
