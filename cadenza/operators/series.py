"""Smoothing of ordered series.

Input: notes or any (piece_id, seq, value column). Recursive filters are folds over the piece's ordered array, and so within the JVM; filters with
a fixed reach are windows. All return (piece_id, seq, smoothed).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_piece, by_seq


def _fold(
    df: DataFrame, column: str, start: Callable[[Column], Column], step: Callable[[Column, Column], Column], emit: Callable[[Column], Column]
) -> DataFrame:
    """A fold over the ordered values of a piece; the state carries the list of what each step emits. start makes the first state."""
    ordered = df.groupBy("piece_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col(column).cast("double").alias("x")))), lambda p: p["x"]).alias("xs")
    )
    first = F.struct(start(F.col("xs")[0]).alias("s"), F.array(F.col("xs")[0]).alias("out"))

    def move(acc: Column, x: Column) -> Column:
        return F.transform(F.array(step(acc["s"], x)), lambda s: F.struct(s.alias("s"), F.array_append(acc["out"], emit(s)).alias("out")))[0]

    out = F.aggregate(F.slice("xs", 2, F.size("xs")), first, move, lambda acc: acc["out"])
    return ordered.select("piece_id", F.posexplode(out).alias("seq", "smoothed"))


def ema(df: DataFrame, column: str = "pitch", alpha: float = 0.3) -> DataFrame:
    return _fold(df, column, lambda x: F.struct(x.alias("v")), lambda s, x: F.struct((x * alpha + s["v"] * (1 - alpha)).alias("v")), lambda s: s["v"])


def double_exponential(df: DataFrame, column: str = "pitch", alpha: float = 0.3, beta: float = 0.1) -> DataFrame:
    """Level and trend; the first value is raw, then level + trend."""

    def step(s: Column, x: Column) -> Column:
        level = x * alpha + (s["level"] + s["trend"]) * (1 - alpha)
        return F.struct(level.alias("level"), ((level - s["level"]) * beta + s["trend"] * (1 - beta)).alias("trend"))

    return _fold(df, column, lambda x: F.struct(x.alias("level"), F.lit(0.0).alias("trend")), step, lambda s: s["level"] + s["trend"])


def kalman(df: DataFrame, column: str = "pitch", process_var: float = 0.01, measure_var: float = 0.1) -> DataFrame:
    """Scalar filter that starts at the first value with variance 1."""

    def step(s: Column, x: Column) -> Column:
        predicted = s["p"] + process_var
        gain = predicted / (predicted + measure_var)
        return F.struct((s["x"] + gain * (x - s["x"])).alias("x"), ((1 - gain) * predicted).alias("p"))

    return _fold(df, column, lambda x: F.struct(x.alias("x"), F.lit(1.0).alias("p")), step, lambda s: s["x"])


def _odd(size: int, least: int = 3) -> int:
    return max(least, size if size % 2 else size + 1)


def _weighted(df: DataFrame, column: str, weights: dict[int, float]) -> DataFrame:
    """Sum of weights[k] times the value k places on; beyond an end, the end's value."""
    whole = by_seq().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = F.col(column).cast("double")
    ends = df.select("piece_id", "seq", x.alias("x"), F.first(x).over(whole).alias("a"), F.last(x).over(whole).alias("z"))
    at = lambda k: F.coalesce(F.lead("x", k).over(by_seq()), F.col("z")) if k > 0 else F.coalesce(F.lag("x", -k).over(by_seq()), F.col("a")) if k < 0 else F.col("x")
    first, *rest = [at(k) * w for k, w in weights.items()]
    return ends.select("piece_id", "seq", sum(rest, first).alias("smoothed"))


def gaussian_weights(size: int = 5, sigma: float | None = None) -> dict[int, float]:
    w = _odd(size)
    s = sigma or 0.25 * w
    raw = {k: math.exp(-0.5 * (k / s) ** 2) for k in range(-(w // 2), w // 2 + 1)}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()}


def gaussian_smooth(df: DataFrame, column: str = "pitch", size: int = 5, sigma: float | None = None) -> DataFrame:
    return _weighted(df, column, gaussian_weights(size, sigma))


def savitzky_golay_weights(size: int = 5, order: int = 2) -> dict[int, float]:
    """Centre row of the least-squares fit of a polynomial over the window."""
    w = _odd(size)
    x = np.arange(-(w // 2), w // 2 + 1, dtype=float)
    a = np.vander(x, min(order, w - 1) + 1, increasing=True)
    return dict(zip(range(-(w // 2), w // 2 + 1), np.linalg.pinv(a)[0].tolist()))


def savitzky_golay(df: DataFrame, column: str = "pitch", size: int = 5, order: int = 2) -> DataFrame:
    """The intended filter: the fitted polynomial's value at the centre, one output for each input."""
    return _weighted(df, column, savitzky_golay_weights(size, order))


def rolling_median(df: DataFrame, column: str = "pitch", size: int = 5) -> DataFrame:
    """Median of a window cut off at the ends; of an even number of values, the upper middle one."""
    half = _odd(size, 1) // 2
    values = F.array_sort(F.collect_list(F.col(column).cast("double")).over(by_seq().rowsBetween(-half, half)))
    return df.select("piece_id", "seq", F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int")).alias("smoothed"))


def wiener(df: DataFrame, column: str = "pitch", size: int = 5) -> DataFrame:
    """Adaptive filter: towards the local mean where the local variance is below the mean local variance. Values beyond the ends count as 0."""
    half, x = size // 2, F.col(column).cast("double")
    frame = by_seq().rowsBetween(-half, half)
    local = df.select(
        "piece_id", "seq", x.alias("x"), (F.sum(x).over(frame) / size).alias("m"), (F.sum(x * x).over(frame) / size).alias("mm")
    ).withColumn("v", F.col("mm") - F.col("m") * F.col("m"))
    noise = local.withColumn("noise", F.avg("v").over(by_piece()))
    return noise.select(
        "piece_id", "seq",
        F.when(F.col("v") < F.col("noise"), F.col("m")).otherwise(
            F.col("m") + (F.col("x") - F.col("m")) * (1 - F.col("noise") / F.col("v"))
        ).alias("smoothed")
    )


#: Smoothers by id, with their parameters and defaults.
REGISTRY: dict[str, tuple[Callable[..., DataFrame], dict[str, float]]] = {
    "kalman": (kalman, {"process_var": 0.01, "measure_var": 0.1}), "ema": (ema, {"alpha": 0.3}), "gaussian": (gaussian_smooth, {"size": 5}),
    "savitzky_golay": (savitzky_golay, {"size": 5, "order": 2}),
    "rolling_median": (rolling_median, {"size": 5}), "double_exponential": (double_exponential, {"alpha": 0.3, "beta": 0.1}),
    "wiener": (wiener, {"size": 5}),
}


def run(df: DataFrame, name: str, column: str = "pitch", **parameters: float) -> DataFrame:
    """Dispatch by id; an unknown id or parameter is an error."""
    if name not in REGISTRY:
        raise ValueError(f"unknown smoother {name}")
    f, defaults = REGISTRY[name]
    if unknown := set(parameters) - set(defaults):
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    return f(df, column, **defaults | parameters)
