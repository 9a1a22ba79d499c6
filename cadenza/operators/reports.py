"""Reports on pieces: impact and its segments, interpretations, era confidences, colours, keys and scales."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_piece, by_seq
from .features import CONSONANCE

PHI = (1 + math.sqrt(5)) / 2
#: Intervals that count as Fibonacci steps.
FIBONACCI = (1, 2, 3, 5, 8, 13)
#: Scales by key, from their tonic.
SCALES = {
    "C_major": (0, 2, 4, 5, 7, 9, 11), "G_major": (7, 9, 11, 0, 2, 4, 6), "F_major": (5, 7, 9, 10, 0, 2, 4), "A_minor": (9, 11, 0, 2, 4, 5, 7),
    "D_minor": (2, 4, 5, 7, 9, 10, 0),
}
#: Eras that a report gives confidences for.
ERAS = ("Baroque", "Classical", "Romantic", "Late Romantic")
#: Measures of a report with the feature each is read from, the feature's range, the two bounds of its levels, and their names.
MEASURES = {
    "melodic_range": ("pitch_range", 0.0, 60.0, 0.3, 0.6, ("Dar", "Orta", "Geniş")),
    "rhythmic_complexity": ("rhythmic_entropy", 0.0, 4.0, 0.3, 0.6, ("Basit", "Orta", "Karmaşık")),
    "harmonic_tension": ("dissonance_index", 0.0, 1.0, 0.3, 0.6, ("Düşük", "Orta", "Yüksek")),
    "thematic_development": ("repetition_index", 0.3, 0.8, 0.3, 0.6, ("Sürekli Varyasyon", "Dengeli", "Yüksek Bütünlük")),
    "textural_density": ("note_density", 0.0, 4.0, 0.3, 0.6, ("İnce", "Orta", "Kalın")),
    "melodic_volatility": ("interval_entropy", 2.5, 4.5, 0.3, 0.6, ("Düşük", "Orta", "Yüksek")),
    "motif_repetition": ("repetition_index", 0.3, 0.8, 0.3, 0.6, ("Sürekli Varyasyon", "Dengeli", "Yüksek Bütünlük")),
    "consonance": ("consonance_score", 0.0, 1.0, 0.4, 0.7, ("Disonant", "Dengeli", "Konsonan")),
    "complexity": ("fractal_dimension", 1.2, 2.2, 0.3, 0.6, ("Basit", "Orta", "Karmaşık")),
}


def _consonance(interval: Column) -> Column:
    return F.get(F.array(*[F.lit(float(c)) for c in CONSONANCE]), (interval % 12).cast("int"))


def _steps(notes: DataFrame) -> DataFrame:
    """Notes with ``iv``, the size of the step from the note before; null at the first."""
    return notes.select("piece_id", "seq", "pitch", "duration", "start", F.abs(F.col("pitch") - F.lag("pitch").over(by_seq())).alias("iv"))


def tension_curve(notes: DataFrame, width: int = 8) -> DataFrame:
    """(piece_id, block, tension): mean step size in octaves over blocks of ``width`` steps."""
    steps = _steps(notes).where("iv IS NOT NULL").withColumn("block", F.floor((F.col("seq") - 1) / width))
    return steps.groupBy("piece_id", "block").agg((F.avg("iv") / 12).alias("tension"))


def impact(notes: DataFrame, width: int = 8) -> DataFrame:
    """(piece_id, impact_score, fibonacci_ratio, mean_consonance, golden_climax_distance, peak_tension, profile) of pieces with two notes or more."""
    iv = F.col("iv")
    fibonacci = F.when(iv.isin(*FIBONACCI) | (iv % 12).isin(*FIBONACCI), 1.0).when(iv.isNotNull(), 0.0)
    climax = F.min_by("start", F.struct(-F.col("pitch"), F.col("seq")))
    end, first = F.max_by(F.col("start") + F.col("duration"), "seq"), F.min_by("start", "seq")
    rows = _steps(notes).groupBy("piece_id").agg(
        F.avg(fibonacci).alias("fibonacci_ratio"), F.avg(_consonance(iv)).alias("mean_consonance"), climax.alias("_climax"), end.alias("_end"),
        first.alias("_first"), F.count("*").alias("_n"),
    ).where("_n > 1")
    total = F.col("_end") - F.col("_first")
    golden = F.when(total > 0, F.abs((F.col("_climax") - F.col("_first")) / total - 1 / PHI)).otherwise(1.0)
    rows = rows.withColumn("golden_climax_distance", golden).join(
        tension_curve(notes, width).groupBy("piece_id").agg(F.max("tension").alias("peak_tension")), "piece_id"
    )
    f, c, g, t = (F.col(x) for x in ("fibonacci_ratio", "mean_consonance", "golden_climax_distance", "peak_tension"))
    score = 0.25 * f + 0.25 * c + 0.25 * F.greatest(F.lit(0.0), 1 - g * 3) + 0.25 * (1 - F.abs(c - 0.65) * 2)
    profile = (
        F.when(
            (f > 0.4) & (g < 0.1), "mathematically_sublime"
        ).when((c > 0.75) & (t < 0.4), "serene_contemplative").when(t > 0.7, "dramatic_passionate")
        .when(c < 0.4, "dark_dissonant").when(f > 0.3, "naturally_flowing").otherwise("balanced_classical")
    )
    return rows.select("piece_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("impact_score"), f, c, g, t, profile.alias("profile"))


def impact_segments(notes: DataFrame) -> DataFrame:
    """(piece_id, segment, position, tension, consonance, fibonacci_ratio, notes): quarters of a piece (and what is left over), of two notes or
    more.
    """
    n, first = F.count("*").over(by_piece()), F.min("start").over(by_piece())
    end = F.max(F.col("start") + F.col("duration")).over(by_piece())
    placed = _steps(notes).withColumns({"_size": F.greatest(F.lit(1), F.floor(n / 4)), "_first": first, "_total": end - first})
    placed = placed.withColumn("segment", F.floor(F.col("seq") / F.col("_size")))
    inside = F.when(F.col("seq") % F.col("_size") != 0, F.col("iv"))
    rows = placed.groupBy("piece_id", "segment").agg(
        ((F.min("start") - F.first("_first")) / F.greatest(F.first("_total"), F.lit(1.0))).alias("position"), (F.avg(inside) / 12).alias("tension"),
        F.avg(_consonance(inside)).alias("consonance"),
        F.avg(F.when(inside.isin(*FIBONACCI), 1.0).when(inside.isNotNull(), 0.0)).alias("fibonacci_ratio"), F.count("*").alias("notes"),
    )
    return rows.where("notes > 1")


def interpretations(matrix: DataFrame) -> DataFrame:
    """(piece_id, measure, value, level): each measure of a report, its feature brought to 0..1, and its level."""

    def read(name: str) -> Column:
        feature, low, high, a, b, levels = MEASURES[name]
        value = F.least(F.greatest((F.col(feature) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
        return F.struct(
            F.lit(name).alias("measure"), value.alias("value"),
            F.when(value < a, levels[0]).when(value < b, levels[1]).otherwise(levels[2]).alias("level")
        )

    return matrix.select("piece_id", F.inline(F.array(*[read(m) for m in MEASURES])))


def era_confidences(pieces: DataFrame, era: Column) -> DataFrame:
    """(piece_id, era, confidence): 0.85 for a piece's own era where it is one of ERAS, else 0.4 for none; the rest is shared among the others."""
    known = F.coalesce(era.isin(*ERAS), F.lit(False))
    own = F.when(known, 0.85).otherwise(0.4)
    each = F.array(
        *[F.struct(F.lit(e).alias("era"), F.when(F.coalesce(era == e, F.lit(False)), own).otherwise((1 - own) / 3).alias("confidence")) for e in ERAS]
    )
    return pieces.select("piece_id", F.inline(each))


def track_report(matrix: DataFrame) -> DataFrame:
    """(piece_id, report): composer, era and all interpretations of a piece as one JSON object."""
    levels = interpretations(matrix).groupBy("piece_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("measure", "level")))).alias("levels")
    )
    return matrix.select("piece_id", "composer", "era").join(levels, "piece_id").select(
        "piece_id", F.to_json(F.struct("composer", "era", "levels")).alias("report")
    )


def is_diatonic(pitch: Column, key: str = "C_major") -> Column:
    return F.pmod(pitch, F.lit(12)).isin(*SCALES.get(key, SCALES["C_major"]))


def diatonic_shares(notes: DataFrame) -> DataFrame:
    """(piece_id, key, share, ends_on_tonic) for each key of SCALES: notes within the scale, and whether the last note is the key's tonic."""
    shares = [F.avg(F.when(is_diatonic(F.col("pitch"), k), 1.0).otherwise(0.0)) for k in SCALES]
    last = F.pmod(F.max_by("pitch", "seq"), F.lit(12))
    each = F.array(
        *[F.struct(F.lit(k).alias("key"), s.alias("share"), (last == SCALES[k][0]).alias("ends_on_tonic")) for k, s in zip(SCALES, shares)]
    )
    return notes.groupBy("piece_id").agg(each.alias("x")).select("piece_id", F.inline("x"))


def diatonic_boost(model: DataFrame, key: str = "C_major", factor: float = 1.5) -> DataFrame:
    """(src, dst, p): a pitch-class model with steps into the scale weighted by ``factor``, and each row's sum one again."""
    boosted = model.select("src", "dst", (F.col("p") * F.when(is_diatonic(F.col("dst"), key), factor).otherwise(1.0)).alias("_b"))
    return boosted.select("src", "dst", (F.col("_b") / F.sum("_b").over(Window.partitionBy("src"))).alias("p"))


#: A palette of five colours.
PALETTE = ("#1a1a2e", "#16213e", "#0f3460", "#e94560", "#f5f5f5")


def _rgb(colour: str) -> tuple[int, int, int]:
    return tuple(int(colour[k : k + 2], 16) for k in (1, 3, 5))


def palette_colours(series: DataFrame, palette: tuple[str, ...] = PALETTE) -> DataFrame:
    """(piece_id, seq, weight, red, green, blue): a value from 0 to 1 placed along a palette (weight from 0 to its last colour) and blended,
    truncating.
    """
    last = len(palette) - 1
    place = F.least(F.greatest(F.col("value"), F.lit(0.0)), F.lit(1.0)) * last
    low = F.least(F.floor(place), F.lit(last)).cast("int")
    high, part = F.least(low + 1, F.lit(last)), place - low
    listed = [F.array(*[F.lit(_rgb(c)[k]) for c in palette]) for k in range(3)]
    blend = [(F.get(x, low) + (F.get(x, high) - F.get(x, low)) * part).cast("int") for x in listed]
    return series.select("piece_id", "seq", place.alias("weight"), *[b.alias(n) for b, n in zip(blend, ("red", "green", "blue"))])


def instrument_impacts(changes: DataFrame) -> DataFrame:
    """(piece_id, time, impact_type, description, factors): what an instrument transition does, from its counts, kind and change of velocity."""
    entering, exiting, kind, change = (F.col(c) for c in ("entering", "exiting", "kind", "velocity_change"))
    only_in, only_out = (entering > 0) & (exiting == 0), (exiting > 0) & (entering == 0)
    what = F.when(only_in, "entrance").when(only_out, "exit").otherwise("transition")
    said = F.when(
        kind == "solo_to_tutti", "solo to full ensemble"
    ).when(kind == "tutti_to_solo", "full ensemble to solo").when(only_in, "new instruments").when(only_out, "instruments leave").otherwise("change")
    factors = F.array_compact(F.array(
        F.when(F.col("impact") > 0.7, "high impact"), F.when(kind == "solo_to_tutti", "building").when(kind == "tutti_to_solo", "intimate"),
        F.when(change > 0.2, "louder").when(change < -0.2, "softer"),
    ))
    return changes.select("piece_id", "time", what.alias("impact_type"), said.alias("description"), F.array_join(factors, ",").alias("factors"))


def instrument_family(program: Column) -> Column:
    """The family of a General MIDI program: sixteen families of eight programs each; other numbers are unknown."""
    families = (
        "piano", "chromatic_percussion", "organ", "guitar", "bass", "strings", "ensemble", "brass", "reed", "pipe", "synth_lead", "synth_pad",
        "synth_effects", "ethnic", "percussive", "sound_effects"
    )
    return F.coalesce(
        F.get(F.array(*[F.lit(f) for f in families]), F.when(program.between(0, 127), F.floor(program / 8).cast("int"))), F.lit("unknown")
    )
