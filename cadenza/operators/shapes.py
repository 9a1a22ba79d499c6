"""Geometry of pitches, chroma frames and keys, all as column expressions and aggregates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_seq
from ..functions.columns import correlation as correlated

PHI = (1 + math.sqrt(5)) / 2
#: Key profiles of Krumhansl and Kessler, from the tonic.
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def circle(notes: DataFrame, radius: float = 1.0) -> DataFrame:
    """(piece_id, seq, x, y): pitch classes on a circle, C at the bottom of the y axis."""
    angle = F.pmod("pitch", F.lit(12)) / 12 * 2 * math.pi - math.pi / 2
    return notes.select("piece_id", "seq", (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))


def spiral(notes: DataFrame, kind: str = "fibonacci") -> DataFrame:
    """(piece_id, seq, x, y): the notes in order along a logarithmic or an Archimedean spiral."""
    theta = F.col("seq") * (0.5 if kind == "fibonacci" else 0.3)
    r = F.pow(F.lit(PHI), theta / (2 * math.pi)) * 0.1 if kind == "fibonacci" else theta * 0.05 + 0.1
    return notes.select("piece_id", "seq", (r * F.cos(theta)).alias("x"), (r * F.sin(theta)).alias("y"))


def spiral_pattern(notes: DataFrame) -> DataFrame:
    """(piece_id, increasing, correlation, is_spiral): share of steps that move away from the centroid of the pitch circle, and correlation of
    angle and log radius.
    """
    w = Window.partitionBy("piece_id")
    at = circle(notes).withColumns({"dx": F.col("x") - F.avg("x").over(w), "dy": F.col("y") - F.avg("y").over(w)})
    polar = at.select("piece_id", "seq", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2).alias("r"), F.atan2("dy", "dx").alias("theta"))
    polar = polar.withColumn(
        "up", F.when(F.lag("r").over(by_seq()).isNotNull(), F.when(F.col("r") > F.lag("r").over(by_seq()) + 1e-12, 1.0).otherwise(0.0))
    )
    out = polar.groupBy("piece_id").agg(
        F.avg("up").alias("increasing"),
        F.coalesce(correlated(F.col("theta"), F.when(F.col("r") > 0, F.log("r")).otherwise(0.0)), F.lit(0.0)).alias("correlation"),
        F.count("*").alias("n")
    )
    return out.select("piece_id", "increasing", "correlation", ((F.col("n") >= 10) & (F.col("increasing") >= 0.7)).alias("is_spiral"))


def chroma(notes: DataFrame, seconds: float = 4.0) -> DataFrame:
    """(piece_id, frame, energy): array of 12, the time that each pitch class starts to sound within a frame."""
    pc = F.pmod("pitch", F.lit(12))
    return notes.groupBy("piece_id", F.floor(F.col("start") / seconds).cast("int").alias("frame")).agg(
        F.array(*[F.sum(F.when(pc == k, F.col("duration")).otherwise(0.0)) for k in range(12)]).alias("energy")
    )


def fold_bins(bins: DataFrame, chroma_bins: int = 12) -> DataFrame:
    """(frame, pc, energy) from (frame, bin, magnitude): every 12th bin summed, each frame normalised to 1."""
    total = F.sum("e").over(Window.partitionBy("frame"))
    return bins.groupBy("frame", (F.col("bin") % chroma_bins).alias("pc")).agg(F.sum("magnitude").alias("e")).select(
        "frame", "pc", F.when(total > 0, F.col("e") / total).otherwise(0.0).alias("energy")
    )


def bin_frequencies(bins: int = 84, per_octave: int = 12, lowest: float = 27.5) -> list[float]:
    return [lowest * 2 ** (k / per_octave) for k in range(bins)]


def _entropy(energy):
    total = F.aggregate(energy, F.lit(0.0), lambda a, x: a + x) + 1e-10
    return F.aggregate(F.transform(energy, lambda x: x / total), F.lit(0.0), lambda a, p: a - p * F.log2(p + 1e-10))


def _mean_energy():
    return F.array(*[F.avg(F.col("energy")[k]) for k in range(12)])


def harmonic_entropy(frames: DataFrame, seconds: float = 4.0) -> DataFrame:
    """(piece_id, global_entropy, local_entropy_mean, local_entropy_std, information_rate, complexity_score)."""
    rows = frames.withColumn("h", _entropy(F.col("energy")))
    out = rows.groupBy("piece_id").agg(
        _mean_energy().alias("m"), F.avg("h").alias("local_entropy_mean"), F.stddev_pop("h").alias("local_entropy_std")
    )
    return out.select(
        "piece_id", _entropy(F.col("m")).alias("global_entropy"), "local_entropy_mean", "local_entropy_std",
        (F.col("local_entropy_mean") / seconds).alias("information_rate"), (F.col("local_entropy_mean") / math.log2(12)).alias("complexity_score")
    )


def keys() -> list[tuple[str, list[float]]]:
    """The 24 keys and their profiles, centred and scaled to length 1, so that correlation is a scalar product up to scale."""
    out = []
    for mode, profile in (("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE)):
        for tonic in range(12):
            p = np.roll(profile, tonic)
            p = (p - p.mean()) / np.linalg.norm(p - p.mean())
            out.append((f"{NAMES[tonic]} {mode}", [float(v) for v in p]))
    return out


def estimate_key(frames: DataFrame) -> DataFrame:
    """(piece_id, key, strength): the key whose profile correlates most with the mean chroma; ties by the order major, minor and tonic."""
    means = frames.groupBy("piece_id").agg(_mean_energy().alias("m"))
    centred = means.withColumn("a", F.aggregate("m", F.lit(0.0), lambda s, x: s + x) / 12).withColumn(
        "c", F.zip_with("m", F.array_repeat("a", 12), lambda x, a: x - a)
    )
    length = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    scores = [
        F.struct(
            F.round(
                F.aggregate(
                    F.zip_with("c", F.array(*[F.lit(v) for v in p]), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
                ) / F.when(length > 0, length),
                9
            ).alias("s"),
            F.lit(-k).alias("k"), F.lit(name).alias("name")
        ) for k,
        (name, p) in enumerate(keys())
    ]
    return centred.withColumn("best", F.array_max(F.array(*scores))).select(
        "piece_id", F.col("best.name").alias("key"), F.coalesce("best.s", F.lit(0.0)).alias("strength")
    )


def tonal_gravity(frames: DataFrame) -> DataFrame:
    """(piece_id, src, dst, p): moves between the strongest pitch classes of successive frames, the first of ties, as shares of the source."""
    strongest = (F.array_position("energy", F.array_max("energy")) - 1).cast("int")
    order = Window.partitionBy("piece_id").orderBy("frame")
    steps = frames.select("piece_id", "frame", strongest.alias("src")).withColumn("dst", F.lead("src").over(order)).where(F.col("dst").isNotNull())
    counts = steps.groupBy("piece_id", "src", "dst").agg(F.count("*").alias("n"))
    return counts.select("piece_id", "src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("piece_id", "src"))).alias("p"))


def fifths_distance(a, b):
    """Steps between two roots on the circle of fifths."""
    d = F.abs(F.pmod(a * 7, F.lit(12)) - F.pmod(b * 7, F.lit(12)))
    return F.least(d, 12 - d)
