"""Markov models of pieces and of pooled corpora, as sparse tables of transitions.

Input: notes (piece_id, seq, pitch, duration). A model is (src, dst, count, p); pooled over pieces, or per piece.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_seq


def pitch_class(pitch: str = "pitch") -> Column:
    return F.pmod(F.col(pitch), F.lit(12))


def duration_level(levels: int = 8) -> Column:
    """Twice the duration, truncated and held to 0..levels - 1."""
    return F.least(F.greatest((F.col("duration") * 2).cast("int"), F.lit(0)), F.lit(levels - 1))


def duration_name() -> Column:
    d = F.col("duration")
    return F.when(d < 0.25, "16th").when(d < 0.5, "8th").when(d < 1.0, "quarter").when(d < 2.0, "half").otherwise("whole")


def transitions(notes: DataFrame, state: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., src, dst, count, p): counts of successive states within a piece, and their share of the source's."""
    by = by or []
    keys = list(dict.fromkeys([*by, "piece_id", "seq"]))
    steps = notes.select(*keys, state.alias("src")).withColumn("dst", F.lead("src").over(by_seq())).where(F.col("dst").isNotNull())
    counts = steps.groupBy(*by, "src", "dst").agg(F.count("*").alias("count"))
    return counts.withColumn("p", F.col("count") / F.sum("count").over(Window.partitionBy(*by, "src")))


def transition_entropy(model: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean entropy in bits of the rows that have any transition."""
    by = by or []
    rows = model.groupBy(*by, "src").agg(F.sum(-F.col("p") * F.log2("p")).alias("h"))
    return rows.groupBy(*by).agg(F.avg("h").alias("entropy"), F.count("*").alias("rows"))


def model_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cosine of two models' probabilities over all pairs of states; 0 if one is empty."""
    x, y = a.select("src", "dst", F.col("p").alias("x")), b.select("src", "dst", F.col("p").alias("y"))
    both = x.join(y, ["src", "dst"], "full_outer")
    norms = F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("y") * F.col("y")))
    return both.agg(F.coalesce(F.sum(F.col("x") * F.col("y")) / F.when(norms > 0, norms), F.lit(0.0)).alias("similarity"))


def smoothed(notes: DataFrame, state: Column) -> DataFrame:
    """(piece_id, src, dst, p): dense per piece, (count + 1) / (row total + states); a row without transitions is uniform."""
    model = transitions(notes, state, ["piece_id"])
    states = notes.select("piece_id", state.alias("s")).distinct()
    n = states.groupBy("piece_id").agg(F.count("*").alias("n"))
    dense = states.select("piece_id", F.col("s").alias("src")).join(
        states.select("piece_id", F.col("s").alias("dst")), "piece_id"
    ).join(n, "piece_id")
    dense = dense.join(
        model.select("piece_id", "src", "dst", "count"), ["piece_id", "src", "dst"], "left"
    ).withColumn("c", F.coalesce("count", F.lit(0)))
    total = F.sum("c").over(Window.partitionBy("piece_id", "src"))
    return dense.select("piece_id", "src", "dst", F.when(total > 0, (F.col("c") + 1) / (total + F.col("n"))).otherwise(1.0 / F.col("n")).alias("p"))


def higher_order(notes: DataFrame, state: Column, order: int) -> DataFrame:
    """(piece_id, src, dst, count, p, p_unseen): a chain over runs of ``order`` + 1 states of a piece, each followed by the run one later.

    p is (count + 1) / (row total + runs), where runs is the number of different runs of the piece; p_unseen is what every transition of
    the row that is not listed has, so that the dense matrix need not be written. A run without a successor has no row; its chances are equal.
    """
    window, width = by_seq(), order + 1
    values = [F.lead(state.cast("string"), k).over(window) for k in range(width)]
    runs = notes.select("piece_id", "seq", F.when(values[-1].isNotNull(), F.concat_ws(",", *values)).alias("src")).where("src IS NOT NULL")
    steps = runs.select("piece_id", "src", F.lead("src").over(window).alias("dst"))
    states = runs.groupBy("piece_id").agg(F.count_distinct("src").alias("_states"))
    counts = steps.where("dst IS NOT NULL").groupBy("piece_id", "src", "dst").agg(F.count("*").alias("count")).join(states, "piece_id")
    total = F.sum("count").over(Window.partitionBy("piece_id", "src")) + F.col("_states")
    return counts.select("piece_id", "src", "dst", "count", ((F.col("count") + 1) / total).alias("p"), (1 / total).alias("p_unseen"))


def features(notes: DataFrame, least: int = 2) -> DataFrame:
    """(piece_id, pitch_entropy, interval_entropy, predictability, pitch_states, common_transitions, top_share): a piece's chains of pitches
    and of steps in scalars.
    """
    steps = notes.select("piece_id", "seq", (F.col("pitch") - F.lag("pitch").over(by_seq())).alias("step")).where("step IS NOT NULL")
    pitch, step = entropy_rate(smoothed(notes, F.col("pitch"))), entropy_rate(smoothed(steps, F.col("step")))
    named = pitch.select("piece_id", F.col("entropy").alias("pitch_entropy"), F.col("predictability").alias("_a"))
    named = named.join(step.select("piece_id", F.col("entropy").alias("interval_entropy"), F.col("predictability").alias("_b")), "piece_id")
    states = notes.groupBy("piece_id").agg(F.count_distinct("pitch").alias("pitch_states"))
    common = common_transitions(notes, F.col("pitch"), least).groupBy("piece_id").agg(
        F.least(F.count("*"), F.lit(20)).alias("common_transitions"), F.max("share").alias("top_share")
    )
    joined = named.join(states, "piece_id").join(common, "piece_id", "left").na.fill(0, ["common_transitions"]).na.fill(0.0, ["top_share"])
    return joined.withColumn("predictability", (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")


def entropy_rate(dense: DataFrame, rounds: int = 200) -> DataFrame:
    """(piece_id, entropy, predictability): rate of the stationary chain, by power iteration, and 1 - rate / log2(states), held to 0..1. A
    piece's states are few.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows.pivot(index="src", columns="dst", values="p").sort_index().sort_index(axis=1).to_numpy()
        v = np.full(len(p), 1 / len(p))
        for _ in range(rounds):
            v = v @ p
        h = float(-(v[:, None] * p * np.log2(np.where(p > 0, p, 1))).sum())
        most = np.log2(len(p))
        return pd.DataFrame(
            [[rows["piece_id"].iloc[0], h, float(min(1, max(0, 1 - h / most))) if most > 0 else 1.0]],
            columns=["piece_id", "entropy", "predictability"]
        )

    return dense.groupBy("piece_id").applyInPandas(run, "piece_id bigint, entropy double, predictability double")


def common_transitions(notes: DataFrame, state: Column, least: int = 2) -> DataFrame:
    """(piece_id, src, dst, count, share, surprise): transitions seen at least ``least`` times; share is of all the piece's transitions,
    surprise its -log2.
    """
    model = transitions(notes, state, ["piece_id"])
    share = F.col("count") / F.sum("count").over(Window.partitionBy("piece_id"))
    return model.select(
        "piece_id", "src", "dst", "count", share.alias("share")
    ).where(F.col("count") >= least).withColumn("surprise", -F.log2("share"))


def rare_transitions(common: DataFrame, threshold: float = 0.1, top: int = 20) -> DataFrame:
    """The ``top`` most surprising transitions of each piece with a share below the threshold; ties by states."""
    order = Window.partitionBy("piece_id").orderBy(F.desc(F.round("surprise", 9)), "src", "dst")
    return common.where(F.col("share") < threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def predict_next(model: DataFrame, top: int = 3, by: list[str] | None = None) -> DataFrame:
    """The ``top`` likeliest successors of each state, ties by state."""
    order = Window.partitionBy(*(by or []), "src").orderBy(F.desc("p"), "dst")
    return model.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def compare_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """(src, dst, difference): absolute difference of probabilities; a missing transition has 0."""
    x, y = a.select("src", "dst", F.col("p").alias("x")), b.select("src", "dst", F.col("p").alias("y"))
    return x.join(y, ["src", "dst"], "full_outer").select(
        "src", "dst", F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))).alias("difference")
    )
