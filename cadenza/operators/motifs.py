"""Motifs: repeated runs of intervals, with support and a shuffle null model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_seq


def interval_ngrams(notes: DataFrame, lengths: tuple[int, ...] = (3,), least_support: int = 2) -> DataFrame:
    """(piece_id, length, pattern, support, first_position): runs of intervals, comma-joined, that start at least ``least_support`` times in
    their piece. Windows of leads, then one aggregate: no piece is gathered.
    """
    steps = notes.select("piece_id", "seq", (F.lead("pitch").over(by_seq()) - F.col("pitch")).alias("iv"))
    most = max(lengths)
    ahead = steps.select("piece_id", "seq", *[F.lead("iv", k).over(by_seq()).alias(f"v{k}") for k in range(most)])
    grams = F.explode(
        F.array(
            *[F.struct(F.lit(n).alias("length"), F.when(F.col(f"v{n - 1}").isNotNull(), F.concat_ws(",", *[F.col(f"v{k}").cast("string") for k in range(n)])).alias("pattern")) for n in lengths]
        )
    )
    rows = ahead.select("piece_id", "seq", grams.alias("g")).select("piece_id", "seq", "g.*").where(F.col("pattern").isNotNull())
    return rows.groupBy("piece_id", "length", "pattern").agg(
        F.count("*").alias("support"), F.min("seq").alias("first_position")
    ).where(F.col("support") >= least_support)


def state_ngrams(notes: DataFrame, column: str = "pitch", least_length: int = 3, most_length: int = 19, least_support: int = 2) -> DataFrame:
    """(piece_id, length, pattern, support): repeated runs of states of up to half the piece."""
    n = F.count("*").over(Window.partitionBy("piece_id"))
    rows = notes.select("piece_id", "seq", n.alias("n"), *[F.lead(column, k).over(by_seq()).alias(f"v{k}") for k in range(most_length)])
    grams = F.explode(
        F.array(
            *[F.struct(F.lit(k).alias("length"), F.when(F.col(f"v{k - 1}").isNotNull() & (F.lit(k) <= F.floor(F.col("n") / 2)), F.concat_ws(",", *[F.col(f"v{i}").cast("string") for i in range(k)])).alias("pattern")) for k in range(least_length, most_length + 1)]
        )
    )
    return rows.select("piece_id", grams.alias("g")).select("piece_id", "g.*").where(F.col("pattern").isNotNull()).groupBy(
        "piece_id", "length", "pattern"
    ).agg(F.count("*").alias("support")).where(
        F.col("support") >= least_support
    )


def mine(
    notes: DataFrame, least_length: int = 4, most_length: int = 12, least_support: int = 3, shuffles: int = 25, top: int | None = 500, seed: int = 42
) -> DataFrame:
    """(piece_id, rank, pattern, length, support, z): motifs against shuffled intervals, best z first; all of them if ``top`` is None.

    One generator per piece shuffles one array on and on, over the patterns in order of length and first appearance, so results depend on
    the seed and the piece alone. Counting shuffled copies is sequential by nature and runs in numpy, a piece at a time.
    """

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        intervals = np.diff(piece.sort_values("seq")["pitch"].to_numpy())
        rng, rows = np.random.default_rng(seed), []
        for n in range(least_length, most_length + 1):
            if len(intervals) < n:
                break
            windows = np.lib.stride_tricks.sliding_window_view(intervals, n)
            found: dict[tuple[int, ...], int] = {}
            for w in map(tuple, windows.tolist()):
                found[w] = found.get(w, 0) + 1
            for pattern, support in found.items():
                if support < least_support:
                    continue
                mixed, counts = intervals.copy(), np.empty(shuffles)
                for k in range(shuffles):
                    rng.shuffle(mixed)
                    counts[k] = (np.lib.stride_tricks.sliding_window_view(mixed, n) == np.array(pattern)).all(axis=1).sum()
                mean, deviation = counts.mean(), counts.std()
                deviation = np.sqrt(mean + 1e-8) if deviation < 1e-6 else deviation
                rows.append((",".join(map(str, pattern)), n, support, float((support - mean) / deviation)))
        rows.sort(key=lambda r: -r[3])
        head = rows[:top]
        out = pd.DataFrame(
            [(piece["piece_id"].iloc[0], k + 1, *r) for k, r in enumerate(head)], columns=["piece_id", "rank", "pattern", "length", "support", "z"]
        )
        return out.astype({"piece_id": "int64", "rank": "int32", "pattern": "object", "length": "int32", "support": "int64", "z": "float64"})

    return notes.select("piece_id", "seq", "pitch").groupBy("piece_id").applyInPandas(
        run, "piece_id bigint, rank int, pattern string, length int, support bigint, z double"
    )


def summary(mined: DataFrame) -> DataFrame:
    """(piece_id, top_pattern, top_length, top_support, top_z, num_patterns_z_ge_2) of pieces with any motif."""
    best = F.min_by(F.struct("pattern", "length", "support", "z"), "rank")
    return mined.groupBy("piece_id").agg(best.alias("b"), F.count_if(F.col("z") >= 2).alias("num_patterns_z_ge_2")).select(
        "piece_id", F.col("b.pattern").alias("top_pattern"), F.col("b.length").alias("top_length"), F.col("b.support").alias("top_support"),
        F.col("b.z").alias("top_z"), "num_patterns_z_ge_2"
    )


def merge_chunks(old: DataFrame, new: DataFrame, key: str = "piece_id") -> DataFrame:
    """Union of result chunks, of which the later one wins for a key, all of its rows."""
    rows = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return rows.withColumn("_last", F.max("_age").over(Window.partitionBy(key))).where("_age = _last").drop("_age", "_last")


def not_done(notes: DataFrame, done: DataFrame, key: str = "piece_id") -> DataFrame:
    """Rows of pieces that have no result yet."""
    return notes.join(done.select(key).distinct(), key, "left_anti")
