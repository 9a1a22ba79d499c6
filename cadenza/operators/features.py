"""Per-piece features of six layers: pitch, interval, harmony, rhythm, structure, spectrum.

Input: notes (piece_id, seq, pitch, duration, start). All but the spectrum and the self-similarity are windows and one aggregate over one
distribution by piece_id. Degenerate pieces give the constants named in each docstring, never nulls.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import by_seq, entropy, share

#: Consonance of each interval class, unison to major seventh.
CONSONANCE = (1.0, 0.0, 0.2, 0.8, 0.8, 0.9, 0.1, 1.0, 0.7, 0.7, 0.3, 0.2)


def with_steps(notes: DataFrame) -> DataFrame:
    """Adds iv (signed interval from the note before), gap (onset distance) and q (duration in sixteenths, half to even)."""
    return notes.withColumns(
        {"iv": F.col("pitch") - F.lag("pitch").over(by_seq()), "gap": F.col("start") - F.lag("start").over(by_seq()), "q": F.rint(F.col("duration") * 4) / 4}
    )


def consonance(interval: Column) -> Column:
    return F.when(interval.isNotNull(), F.element_at(F.array(*[F.lit(c) for c in CONSONANCE]), F.pmod(F.abs(interval), F.lit(12)).cast("int") + 1))


def _pitch() -> list[Column]:
    pc = F.pmod(F.col("pitch"), F.lit(12))
    counts = [F.count_if(pc == k) for k in range(12)]
    n = F.count("*").cast("double")
    return [
        entropy(counts).alias("pitch_entropy"), (F.greatest(*counts) / n).alias("tonal_center_strength"),
        (F.max("pitch") - F.min("pitch")).cast("double").alias("pitch_range"),
        F.avg("pitch").alias("pitch_mean"), F.stddev_pop("pitch").alias("pitch_std"),
        F.size(F.filter(F.array(*counts), lambda c: c > 0)).cast("double").alias("chromatic_saturation"),
        *[(c / n).alias(f"pc_{k}") for k, c in enumerate(counts)],
    ]


def pitch_features(notes: DataFrame) -> DataFrame:
    """Entropy in bits, strongest class, range, mean, population deviation, distinct classes, and the 12 class shares."""
    return notes.groupBy("piece_id").agg(*_pitch())


def _interval() -> list[Column]:
    clipped = F.when(F.col("iv").isNotNull(), F.greatest(F.least(F.col("iv"), F.lit(12)), F.lit(-12)))  # least and greatest pass over nulls
    moved = F.count_if(F.col("iv") != 0)
    size = F.abs(F.col("iv"))
    return [
        entropy([F.count_if(clipped == k) for k in range(-12, 13)]).alias("interval_entropy"),
        F.coalesce(F.sum(F.signum("iv")) / F.when(moved > 0, moved), F.lit(0.0)).alias("directional_bias"),
        F.coalesce(share(size <= 2), F.lit(0.0)).alias("step_ratio"), F.coalesce(share(size > 4), F.lit(0.0)).alias("leap_ratio"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("mean_interval"), F.coalesce(F.stddev_pop(size), F.lit(0.0)).alias("interval_std"),
    ]


def interval_features(notes: DataFrame) -> DataFrame:
    """Six measures of successive intervals; all 0 for fewer than two notes."""
    return with_steps(notes).groupBy("piece_id").agg(*_interval())


def _harmony() -> list[Column]:
    score = F.coalesce(F.avg(consonance(F.col("iv"))), F.lit(0.0))
    return [score.alias("consonance_score"), (1.0 - score).alias("dissonance_index"), F.stddev_pop("duration").alias("duration_variance")]


def harmony_features(notes: DataFrame) -> DataFrame:
    """Mean consonance (0 for one note, so dissonance 1), and the deviation of durations, which goes by the name of a variance."""
    return with_steps(notes).groupBy("piece_id").agg(*_harmony())


def _rhythm() -> list[Column]:
    cv = lambda c: F.coalesce(F.when(F.avg(c) != 0, F.stddev_pop(c) / (F.avg(c) + 1e-8)), F.lit(0.0))
    total = F.max("start") + F.max_by("duration", "seq")
    return [
        F.avg(-F.log2(F.col("same_q") / F.col("notes_in_piece"))).alias("rhythmic_entropy"),
        F.when(total > 0, F.count("*") / total).otherwise(0.0).alias("note_density"),
        cv("duration").alias("syncopation_estimate"), cv("gap").alias("tempo_variance"), F.avg("duration").alias("duration_mean"),
        F.stddev_pop("duration").alias("duration_std"),
    ]


def _with_rhythm(steps: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return steps.withColumns(
        {"same_q": F.count("*").over(Window.partitionBy("piece_id", "q")), "notes_in_piece": F.count("*").over(Window.partitionBy("piece_id"))}
    )


def rhythm_features(notes: DataFrame) -> DataFrame:
    """Entropy of durations in sixteenths is the mean surprise over notes, so a window replaces a second aggregate. Total time ends with the
    last note's own duration.
    """
    return _with_rhythm(with_steps(notes)).groupBy("piece_id").agg(*_rhythm())


def fractal_dimension(notes: DataFrame, most: int = 8) -> DataFrame:
    """Box counting over s = 2 to ``most`` boxes a side; 1.0 for fewer than four notes."""
    from pyspark.sql import Window

    w = Window.partitionBy("piece_id")
    n, low, high = F.count("*").over(w), F.min("pitch").over(w), F.max("pitch").over(w)
    placed = notes.select("piece_id", "seq", n.alias("n"), ((F.col("pitch") - low) / (high - low + 1e-8)).alias("p"))
    boxes = placed.select("piece_id", "n", "seq", "p", F.explode(F.sequence(F.lit(2), F.lit(most))).alias("s"))
    box = F.struct((F.col("seq") / (F.col("n") / F.col("s"))).cast("int"), (F.col("p") * F.col("s")).cast("int"))
    counted = boxes.groupBy("piece_id", "n", "s").agg(F.count_distinct(box).alias("c"))
    slope = -F.regr_slope(F.log(F.col("c").cast("double")), F.log(1.0 / F.col("s")))
    return counted.groupBy("piece_id").agg(F.when(F.max("n") < 4, 1.0).otherwise(slope).alias("fractal_dimension"))


def window_histograms(pitches: np.ndarray, window: int) -> np.ndarray:
    """Pitch-class histograms of all windows but the last, of length one."""
    n = len(pitches) - window
    if n <= 0:
        return np.zeros((0, 12))
    running = np.vstack([np.zeros(12), np.cumsum(np.eye(12)[pitches % 12], axis=0)])
    hist = running[window : window + n] - running[:n]
    return hist / np.linalg.norm(hist, axis=1, keepdims=True)


def _mean_similarity(pitches: np.ndarray, window: int, apart: int) -> float:
    """The mean cosine of windows at least ``apart`` steps apart; 0 for fewer than ten windows. From sums of histograms, with no matrix of pairs."""
    hist = window_histograms(pitches, window)
    n = len(hist) - apart
    if len(hist) < 10 or n <= 0:
        return 0.0
    later = np.cumsum(hist[::-1], axis=0)[::-1]  # of each window and all after it
    return float((hist[:n] * later[apart:]).sum() / (n * (n + 1) / 2))


def _spectrum(pitches: np.ndarray) -> tuple[float, float, float, float]:
    power = np.abs(np.fft.rfft(pitches - pitches.mean())) ** 2
    total = power.sum()
    if total < 1e-12:
        return 0.0, 0.0, 0.0, 0.0
    p = power[power > 0] / total
    return float((np.arange(len(power)) * power).sum() / total), float(-(p * np.log2(p)).sum()), float(power.argmax()), float(
        np.exp(np.log(power + 1e-8).mean()) / (power.mean() + 1e-8)
    )


def _of_pitches(rows: DataFrame, measure: Callable[[np.ndarray], tuple[float, ...]], names: Sequence[str]) -> DataFrame:
    """rows without their last column, the ordered pitches, and with what ``measure`` makes of them."""
    kept = rows.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(np.array(p.as_py())) for p in batch.column(len(kept))]
            yield pa.record_batch([*batch.columns[:-1], *_columns(found, len(names))], [*batch.schema.names[:-1], *names])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept), *(f"{c} double" for c in names)])
    return rows.mapInArrow(run, schema)


def _ordered_pitches() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("seq", "pitch"))), lambda x: x["pitch"].cast("double")).alias("_pitches")


def _mean_consonance(pitches: np.ndarray) -> float:
    """The mean consonance of successive intervals, added up in order, so that a mean that lies on a bound does not depend on how rows are sorted; 0 for one note."""
    scores = np.array(CONSONANCE)[np.abs(np.diff(pitches)).astype(int) % 12]
    return float(np.cumsum(scores)[-1] / len(scores)) if len(scores) else 0.0


def _sequential(x: np.ndarray, window: int, apart: int) -> tuple[float, ...]:
    """The measures of _SEQUENTIAL of one piece's pitches, and the consonance and dissonance."""
    consonant = _mean_consonance(x)
    return (*_spectrum(x), _mean_similarity(x.astype(int), window, apart), _box_dimension(x), consonant, 1.0 - consonant)


def _columns(rows: list[tuple[float, ...]], n: int) -> list[pa.Array]:
    return [pa.array(c, pa.float64()) for c in zip(*rows)] if rows else [pa.array([], pa.float64())] * n


def spectral_features(notes: DataFrame) -> DataFrame:
    """Spectrum of the mean-free pitches (all 0 without any change).

    A Fourier transform is not an aggregate that SQL has; it runs in numpy on the piece's ordered pitches, where the row is.
    """
    return _of_pitches(notes.groupBy("piece_id").agg(_ordered_pitches()), _spectrum, _SEQUENTIAL[:4])


def structural_features(notes: DataFrame) -> DataFrame:
    """Repetition, fractal dimension, distinct pitch classes, note count, in one pass over the notes."""
    classes = F.size(F.collect_set(F.pmod("pitch", F.lit(12)))).cast("double").alias("unique_pitch_classes")
    rows = notes.groupBy("piece_id").agg(classes, F.count("*").cast("double").alias("total_notes"), _ordered_pitches())
    return _of_pitches(rows, lambda x: (_mean_similarity(x.astype(int), 20, 5), _box_dimension(x)), _SEQUENTIAL[4:])


def self_similarity(notes: DataFrame, window: int = 20) -> DataFrame:
    """(piece_id, i, j, similarity) for i <= j: the matrix of cosines between pitch-class histograms of windows, as rows; pieces of ``window``
    notes or fewer have none.

    The matrix is quadratic in a piece's notes by definition; it comes out line by line, so that no more than one line is held.
    """
    rows = notes.groupBy("piece_id").agg(_ordered_pitches())
    kind = notes.schema["piece_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, pitches in enumerate(batch.column(1)):
                hist = window_histograms(np.array(pitches.as_py()).astype(int), window)
                for i in range(len(hist)):
                    j = np.arange(i, len(hist), dtype=np.int32)
                    piece = batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(j), np.int64)))
                    yield pa.record_batch(
                        [piece, pa.array(np.full(len(j), i, np.int32)), pa.array(j), pa.array(hist[i:] @ hist[i])],
                        ["piece_id", "i", "j", "similarity"]
                    )

    return rows.mapInArrow(run, f"piece_id {kind}, i int, j int, similarity double")


def _box_dimension(pitches: np.ndarray, most: int = 8) -> float:
    """What fractal_dimension() computes, for one piece in memory."""
    n = len(pitches)
    if n < 4:
        return 1.0
    unit = (pitches - pitches.min()) / (pitches.max() - pitches.min() + 1e-8)
    sides = range(2, most + 1)
    counts = [len(set(zip((np.arange(n) / (n / s)).astype(int).tolist(), (unit * s).astype(int).tolist()))) for s in sides]
    return float(-np.polyfit(np.log(1 / np.array(sides)), np.log(counts), 1)[0])


_SEQUENTIAL = ("spectral_centroid", "spectral_entropy", "dominant_frequency", "spectral_flatness", "repetition_index", "fractal_dimension")


def feature_matrix(notes: DataFrame, pieces: DataFrame | None = None, least_notes: int = 20, window: int = 20, apart: int = 5) -> DataFrame:
    """All 41 features of pieces with at least ``least_notes`` notes, with composer and era if pieces are given.

    One distribution by piece serves everything: the aggregate also keeps the piece's pitches in order, and what needs the whole sequence is
    computed from that array where the row is.
    """
    steps = _with_rhythm(with_steps(notes))
    wide = steps.groupBy("piece_id").agg(
        *_pitch(), *_interval(), _harmony()[-1], *_rhythm(), F.count("*").cast("double").alias("total_notes"), _ordered_pitches()
    ).where(F.col("total_notes") >= least_notes)
    wide = wide.select(*[c for c in wide.columns if c != "_pitches"], F.col("chromatic_saturation").alias("unique_pitch_classes"), "_pitches")

    full = _of_pitches(wide, lambda x: _sequential(x, window, apart), (*_SEQUENTIAL, "consonance_score", "dissonance_index"))
    return full if pieces is None else full.join(pieces, "piece_id", "left")
