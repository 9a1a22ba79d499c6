"""What further pictures of a piece draw, as rows of points, columns, samples and segments, without drawing them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_piece, by_seq
from ..functions.storage import stored

PHI = (1 + math.sqrt(5)) / 2
#: Levels of the golden divisions of a piece.
GOLDEN_DEPTH = 8


def golden_places(depth: int = GOLDEN_DEPTH) -> list[float]:
    """Golden divisions of the unit interval from either end."""
    return sorted({p for d in range(1, depth + 1) for p in (1 / PHI**d, 1 - 1 / PHI**d)})


def _level(column: Column) -> Column:
    """A value's place between the piece's least and greatest; one half where they are equal."""
    low, high = F.min(column).over(by_piece()), F.max(column).over(by_piece())
    return F.coalesce((column - low) / F.when(high > low, high - low), F.lit(0.5))


def golden_arc(notes: DataFrame, width: int = 1200, height: int = 800) -> DataFrame:
    """(piece_id, seq, x, y, level, dot): a point for each note of pieces with two or more, on a spiral that turns by the golden ratio over the piece;
    dot is 6, 4 or 2 by how near the note's time is to a golden division.
    """
    first = F.min_by("start", "seq").over(by_piece())
    last = F.max_by(F.col("start") + F.col("duration"), "seq").over(by_piece())
    rows = notes.select("piece_id", "seq", "start", first.alias("a"), (last - first).alias("span"), F.count("*").over(by_piece()).alias("n"), _level(F.col("pitch").cast("double")).alias("level"))
    at = (F.col("start") - F.col("a")) / F.when(F.col("span") > 0, F.col("span")).otherwise(F.col("n").cast("double"))
    near = F.least(*[F.abs(F.col("at") - p) for p in golden_places()])
    angle, radius = F.col("at") * (2 * math.pi * PHI), min(width, height) * 0.42 * (0.3 + 0.7 * F.col("level"))
    return rows.where("n > 1").withColumn("at", at).select(
        "piece_id", "seq", (width // 2 + radius * F.cos(angle)).alias("x"), (height // 2 + radius * F.sin(angle)).alias("y"), "level",
        F.when(near < 0.02, 6).when(near < 0.05, 4).otherwise(2).alias("dot"),
    )


def spectral_columns(notes: DataFrame, width: int = 1200) -> DataFrame:
    """(piece_id, seq, x, bright, pitch_level, duration_level, step_level): a column for each note of pieces with two or more: where it stands, the row
    from 0 to 11 that is bright, and the levels that colour it.
    """
    step = F.coalesce(F.abs(F.col("pitch") - F.lag("pitch").over(by_seq())) / 12.0, F.lit(0.0))
    rows = notes.select("piece_id", "seq", "pitch", "duration", step.alias("step"), F.count("*").over(by_piece()).alias("n")).where("n > 1")
    return rows.select(
        "piece_id", "seq", (F.col("seq") / (F.col("n") - 1) * (width - 1)).alias("x"), F.pmod("pitch", F.lit(12)).cast("int").alias("bright"),
        _level(F.col("pitch").cast("double")).alias("pitch_level"), _level(F.col("duration")).alias("duration_level"), _level(F.col("step")).alias("step_level"),
    )


def waveform(notes: DataFrame, width: int = 1200) -> DataFrame:
    """(piece_id, pixel, sample): damped tones of the notes of pieces with two or more, each from its place on, summed by pixel; pixels without a tone
    have no row. A note makes as many rows as pixels, its share of the width.
    """
    n = F.count("*").over(by_piece())
    rows = notes.select("piece_id", "seq", "pitch", "duration", n.alias("n"), _level(F.col("pitch").cast("double")).alias("level")).where("n > 1")
    begin = F.floor(F.col("seq") / (F.col("n") - 1) * (width - 1)).cast("int")
    length = F.greatest(F.lit(1), F.floor(F.col("duration") / 4.0 * width / F.col("n")).cast("int"))
    tones = rows.withColumns({"begin": begin, "length": length})
    tones = tones.withColumn("pixel", F.explode(F.sequence("begin", F.least(F.col("begin") + F.col("length"), F.lit(width)) - 1)))
    t = (F.col("pixel") - F.col("begin")) / F.col("length")
    frequency = 0.5 + F.pmod("pitch", F.lit(12)) / 12.0 * 4
    sample = (0.2 + F.col("level") * 0.8) * F.sin(2 * math.pi * frequency * t) * F.exp(-t * 2)
    return tones.groupBy("piece_id", "pixel").agg(F.sum(sample).alias("sample"))


def fractal_segments(notes: DataFrame, width: int = 1200, height: int = 800, depth: int = 8) -> DataFrame:
    """(piece_id, level, node, x0, x1, left_y, right_y): halves of halves of pieces with four notes or more, up to ``depth`` levels: the stretch that a
    node covers, and the heights of its halves' mean pitches.

    A level is made from the one before it by halving its rows; means come from running sums, met by their places, so no piece is gathered.
    """
    sums = F.sum(F.col("pitch").cast("double")).over(by_seq().rowsBetween(Window.unboundedPreceding, 0))
    after = notes.select("piece_id", (F.col("seq") + 1).cast("int").alias("at"), sums.alias("total"))
    totals = stored(after.unionByName(notes.select("piece_id", F.lit(0).alias("at"), F.lit(0.0).alias("total")).distinct()))
    whole = notes.groupBy("piece_id").agg(F.count("*").cast("int").alias("hi")).where("hi >= 4")
    levels = F.least(F.lit(depth), F.floor(F.log2(F.col("hi").cast("double")))).cast("int")
    row = whole.select("piece_id", levels.alias("levels"), F.lit(0).alias("level"), F.lit(0).alias("node"), F.lit(0).alias("lo"), "hi", F.lit(0.0).alias("x0"), F.lit(float(width)).alias("x1"))
    every = row
    for _ in range(depth - 1):
        half = row.withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
        left, middle = F.col("side") == 0, (F.col("x0") + F.col("x1")) / 2
        row = half.select(
            "piece_id", "levels", (F.col("level") + 1).alias("level"), (F.col("node") * 2 + F.col("side")).alias("node"),
            F.when(left, F.col("lo")).otherwise(F.col("mid")).alias("lo"), F.when(left, F.col("mid")).otherwise(F.col("hi")).alias("hi"),
            F.when(left, F.col("x0")).otherwise(middle).alias("x0"), F.when(left, middle).otherwise(F.col("x1")).alias("x1"),
        ).where("level < levels and hi - lo >= 2")
        every = every.unionByName(row)
    cut = every.where("hi - lo >= 2").withColumn("mid", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))
    for place in ("lo", "mid", "hi"):
        cut = cut.join(totals.select("piece_id", F.col("at").alias(place), F.col("total").alias(f"to_{place}")), ["piece_id", place])
    y = lambda a, b: height * 0.5 * (1.0 - ((F.col(f"to_{b}") - F.col(f"to_{a}")) / (F.col(b) - F.col(a)) - 36) / 60.0)
    return cut.select("piece_id", "level", "node", "x0", "x1", y("lo", "mid").alias("left_y"), y("mid", "hi").alias("right_y"))
