"""What pictures of a piece show, as rows: cells and bars with their values, without drawing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_piece
from . import series


def _share_of_most(value: str) -> Column:
    """A cell's value as a share of the piece's greatest; 0 where all are."""
    most = F.max(value).over(by_piece())
    return F.coalesce(F.col(value) / F.when(most > 0, most), F.lit(0.0))


def emotion_cells(notes: DataFrame, columns: int = 50, velocity: float = 64.0) -> DataFrame:
    """(piece_id, row, col, value): pitch classes from the top down against up to ``columns`` stretches of notes; half length, half loudness,
    as a share of the most.
    """
    n = F.count("*").over(by_piece())
    placed = notes.select(
        "piece_id", "duration", (11 - F.pmod("pitch", F.lit(12))).cast("int").alias("row"),
        F.floor(F.col("seq") / n * F.least(F.lit(columns), n)).cast("int").alias("col")
    )
    cells = placed.groupBy("piece_id", "row", "col").agg(F.sum(F.col("duration") * 0.5 + velocity / 127 * 0.5).alias("sum"))
    return cells.select("piece_id", "row", "col", _share_of_most("sum").alias("value"))


def spectrogram_cells(notes: DataFrame, frames: int = 100, velocity: float = 64.0) -> DataFrame:
    """(piece_id, pc, frame, value): energy of pitch classes in up to ``frames`` stretches of time, as a share of the most."""
    n, total = F.count("*").over(by_piece()), F.max_by(F.col("start") + F.col("duration"), "seq").over(by_piece())
    timed = notes.select(
        "piece_id", F.pmod("pitch", F.lit(12)).alias("pc"), "start", "duration", n.alias("n"), total.alias("total")
    ).where("total > 0")
    frame = F.floor(F.col("start") / F.col("total") * (F.least(F.lit(frames), F.col("n")) - 1)).cast("int")
    cells = timed.groupBy("piece_id", "pc", frame.alias("frame")).agg(
        F.sum(velocity / 127 * (F.col("duration") / F.col("total") * F.col("n"))).alias("sum")
    )
    return cells.select("piece_id", "pc", "frame", _share_of_most("sum").alias("value"))


def smoothed_bars(notes: DataFrame, width: int = 1200, height: int = 800) -> DataFrame:
    """(piece_id, seq, x, level, middle, size): a bar for each note of pieces with two or more: its place, smoothed level in 0..1, the bar's
    middle from the top, and its height by the step before it.
    """
    smooth = series.kalman(notes, process_var=0.02, measure_var=0.08).select("piece_id", "seq", "smoothed")
    low, high = F.min("smoothed").over(by_piece()), F.max("smoothed").over(by_piece())
    level = F.coalesce((F.col("smoothed") - low) / F.when(high > low, high - low), F.lit(0.5))
    step = F.abs(F.col("pitch") - F.lag("pitch").over(by_piece().orderBy("seq")))
    n = F.count("*").over(by_piece())
    rows = notes.select("piece_id", "seq", n.alias("n"), F.coalesce(F.least(F.lit(1.0), step / 12), F.lit(0.5)).alias("speed")).where("n > 1")
    rows = rows.join(smooth.select("piece_id", "seq", level.alias("level")), ["piece_id", "seq"])
    middle, size = (1 - F.col("level")) * height * 0.8 + height * 0.1, height * 0.05 + height * 0.15 * F.col("speed")
    return rows.select(
        "piece_id", "seq", (F.col("seq") / (F.col("n") - 1) * (width - 1)).alias("x"), "level", middle.alias("middle"), size.alias("size")
    )
