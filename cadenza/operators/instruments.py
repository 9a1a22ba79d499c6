"""Instrument intervals: transitions and layers, by band and overlap joins within a piece.

Input: instruments (piece_id, event_type, entry, exit, note_count, velocity). All joins have the piece as equality key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transitions(instruments: DataFrame, resolution: float = 0.5) -> DataFrame:
    """(piece_id, time, entering, exiting, continuing, kind, velocity_change, density_change, impact) for each entry or exit time.

    entering and exiting lie within ``resolution`` of the time, continuing span it strictly. One join over the three conditions, then conditional aggregates.
    """
    times = instruments.select("piece_id", F.explode(F.array("entry", "exit")).alias("time")).distinct()
    i = instruments.select(F.col("piece_id").alias("p"), "event_type", "entry", "exit", "velocity")
    enters, leaves = F.abs(F.col("entry") - F.col("time")) < resolution, F.abs(F.col("exit") - F.col("time")) < resolution
    spans = (F.col("entry") < F.col("time")) & (F.col("exit") > F.col("time"))
    met = times.join(i, (F.col("piece_id") == F.col("p")) & (enters | leaves | spans))
    n = lambda c: F.count_if(c)
    held = F.sum(F.when(leaves, F.col("velocity")).otherwise(0.0) + F.when(spans, F.col("velocity")).otherwise(0.0))
    families = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("event_type"))))
    rows = met.groupBy("piece_id", "time").agg(
        n(enters).alias("entering"), n(leaves).alias("exiting"), n(spans).alias("continuing"), F.avg(F.when(enters, F.col("velocity"))).alias("_in"),
        held.alias("_held"), families(enters).alias("_fi"), families(leaves).alias("_fo")
    ).where("entering + exiting > 0")
    before, after = F.col("continuing") + F.col("exiting"), F.col("continuing") + F.col("entering")
    kind = F.when(
        (before == 1) & (after > 1), "solo_to_tutti"
    ).when((before > 1) & (after == 1), "tutti_to_solo").when(before < after, "thickening").when(before > after, "thinning").otherwise("voice_change")
    change = F.when((F.col("entering") > 0) & (before > 0), (F.col("_in") - F.col("_held") / before) / 127).otherwise(0.0)
    density = F.col("entering") - F.col("exiting")
    impact = F.least(
        F.lit(1.0), F.abs(change) * 0.3 + F.least(F.abs(density) * 0.2, F.lit(0.4)) + F.when(F.col("_fi") != F.col("_fo"), 0.2).otherwise(0.0)
    )
    return rows.select(
        "piece_id", "time", "entering", "exiting", "continuing", kind.alias("kind"), change.alias("velocity_change"), density.alias("density_change"),
        impact.alias("impact")
    )


def layers(instruments: DataFrame, changes: DataFrame) -> DataFrame:
    """(piece_id, start_time, end_time, thickness, is_tutti, is_solo): instruments that overlap the stretch between consecutive transitions;
    tutti from four on.
    """
    stretches = changes.select(
        "piece_id", F.col("time").alias("start_time"), F.lead("time").over(Window.partitionBy("piece_id").orderBy("time")).alias("end_time")
    ).where(F.col("end_time").isNotNull())
    i = instruments.select(F.col("piece_id").alias("p"), "entry", "exit")
    met = stretches.join(i, (F.col("piece_id") == F.col("p")) & (F.col("entry") <= F.col("end_time")) & (F.col("exit") >= F.col("start_time")))
    return met.groupBy("piece_id", "start_time", "end_time").agg(F.count("*").alias("thickness")).withColumns(
        {"is_tutti": F.col("thickness") >= 4, "is_solo": F.col("thickness") == 1}
    )


def features(instruments: DataFrame, changes: DataFrame, stacked: DataFrame) -> DataFrame:
    """(piece_id, instruments, transitions, layers, mean_thickness, solo_share, mean_impact, max_impact)."""
    a = instruments.groupBy("piece_id").agg(F.count("*").alias("instruments"))
    b = changes.groupBy("piece_id").agg(F.count("*").alias("transitions"), F.avg("impact").alias("mean_impact"), F.max("impact").alias("max_impact"))
    c = stacked.groupBy("piece_id").agg(
        F.count("*").alias("layers"), F.avg("thickness").alias("mean_thickness"),
        F.avg(F.when(F.col("is_solo"), 1.0).otherwise(0.0)).alias("solo_share")
    )
    return a.join(b, "piece_id", "left").join(c, "piece_id", "left")
