"""Shapes on the pitch circle, key segments and cycles of chroma frames, and the random-walk score of intervals.

Choosing shapes that share no notes, growing a key segment frame by frame and shuffling a series are sequential by nature; they run in numpy on
one piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shapes import NAMES, PHI, fifths_distance, keys

SHAPES = {3: "triangle", 4: "square", 5: "pentagon", 6: "hexagon", 8: "octagon"}


def _frame(rows: list[tuple], columns: dict[str, str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(columns)).astype(columns)


def nonrandomness(notes: DataFrame, most_lag: int = 8, shuffles: int = 20, seed: int = 42) -> DataFrame:
    """(piece_id, rw_corr_mean, rw_corr_z): mean absolute autocorrelation of z-scored intervals at lags up to most_lag, and its z-score against
    shuffled copies, seeded for each piece alike; 0 without variation or for fewer than six notes.
    """

    def measure(z: np.ndarray, lags: int) -> float:
        return float(np.mean([abs(np.dot(z[:-k], z[k:]) / (len(z) - k)) for k in range(1, lags + 1)]))

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        steps = np.diff(piece.sort_values("seq")["pitch"].to_numpy(float))
        mean = z = 0.0
        lags = min(most_lag, len(steps) // 2)
        if len(steps) >= 5 and steps.std() > 0 and lags:
            unit, rng = (steps - steps.mean()) / steps.std(), np.random.default_rng(seed)
            mean, null = measure(unit, lags), []
            for _ in range(shuffles):
                mixed = unit.copy()
                rng.shuffle(mixed)
                null.append(measure(mixed, lags))
            z = float((mean - np.mean(null)) / np.std(null)) if np.std(null) > 0 else 0.0
        return _frame([(piece["piece_id"].iloc[0], mean, z)], {"piece_id": "int64", "rw_corr_mean": "float64", "rw_corr_z": "float64"})

    return notes.select("piece_id", "seq", "pitch").groupBy("piece_id").applyInPandas(run, "piece_id bigint, rw_corr_mean double, rw_corr_z double")


def _polygon(points: np.ndarray) -> tuple[float, np.ndarray]:
    """Variation of the distances from the centroid (infinite where all points coincide), and the angles between successive corners."""
    arms = points - points.mean()
    r = np.abs(arms)
    turn = np.abs(np.angle(np.roll(arms, -1)) - np.angle(arms))
    return (float(r.std() / r.mean()) if r.mean() > 1e-9 else np.inf), np.minimum(turn, 2 * np.pi - turn)


def shapes(notes: DataFrame, tolerance: float = 0.1, star_tolerance: float = 0.15, most: int = 10, most_stars: int = 5) -> DataFrame:
    """(piece_id, shape, start, corners, confidence): regular polygons of successive notes on the pitch circle, surest first and without shared
    notes, and the first stars, whose corners are taken two apart.
    """

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        pitch = piece.sort_values("seq")["pitch"].to_numpy()
        at = np.exp(1j * (pitch % 12 / 12 * 2 * np.pi - np.pi / 2))
        found, stars = [], []
        for corners, name in SHAPES.items():
            for start in range(len(at) - corners + 1):
                spread, turns = _polygon(at[start : start + corners])
                uneven = float(np.var(turns / (2 * np.pi / corners) - 1))
                if spread < tolerance and uneven < tolerance:
                    found.append((name, start, corners, round(1 - (spread + uneven) / 2, 3)))
        used, kept = set(), []
        for shape in sorted(found, key=lambda s: -s[3]):
            own = set(range(shape[1], shape[1] + shape[2]))
            if not own & used:
                used |= own
                kept.append(shape)
        for corners, name in ((5, "star_pentagon"), (6, "star_triangle")):
            for start in range(len(at) - corners + 1):
                spread = _polygon(at[start + np.arange(corners) * 2 % corners])[0]
                if spread < star_tolerance:
                    stars.append((name, start, corners, round(1 - spread, 3)))
        rows = [(piece["piece_id"].iloc[0], *s) for s in kept[:most] + stars[:most_stars]]
        return _frame(rows, {"piece_id": "int64", "shape": "object", "start": "int32", "corners": "int32", "confidence": "float64"})

    return notes.select("piece_id", "seq", "pitch").groupBy("piece_id").applyInPandas(
        run, "piece_id bigint, shape string, start int, corners int, confidence double"
    )


def mandala(notes: DataFrame, layers: int = 3, points: int = 12, radius: float = 100.0) -> DataFrame:
    """(piece_id, layer, radius, num_points, symmetry_order): up to ``points`` notes from each third of a piece of at least 12; symmetry is the
    smallest divisor of the count from two to its half, or the count.
    """
    n = notes.groupBy("piece_id").agg(F.count("*").alias("n")).where("n >= 12")
    rows = n.select("piece_id", "n", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"))
    count = F.least(F.lit(points), F.col("n") - F.col("layer") * F.floor(F.col("n") / layers)).cast("int")
    divisors = F.filter(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.floor(F.col("num_points") / 2).cast("int"))),
        lambda d: (F.col("num_points") % d == 0) & (d <= F.col("num_points") / 2)
    )
    rows = rows.select("piece_id", "layer", ((F.col("layer") + 1) * radius / layers).alias("radius"), count.alias("num_points"))
    return rows.withColumn("symmetry_order", F.coalesce(F.get(divisors, F.lit(0)), F.col("num_points")))


def geometric_complexity(notes: DataFrame) -> DataFrame:
    """(piece_id, complexity, shapes, kinds, is_spiral, layers): kinds of shapes by .1, a spiral by .2, layers by .1 and shapes by .05, at most 1."""
    from .shapes import spiral_pattern

    found = shapes(notes).groupBy("piece_id").agg(F.count("*").alias("shapes"), F.count_distinct("shape").alias("kinds"))
    layers = mandala(notes).groupBy("piece_id").agg(F.count("*").alias("layers"))
    rows = notes.select("piece_id").distinct().join(found, "piece_id", "left").join(layers, "piece_id", "left").na.fill(0)
    rows = rows.join(spiral_pattern(notes).select("piece_id", "is_spiral"), "piece_id", "left").na.fill(False)
    score = F.col("kinds") * 0.1 + F.col("is_spiral").cast("int") * 0.2 + F.col("layers") * 0.1 + F.col("shapes") * 0.05
    return rows.select("piece_id", F.least(F.lit(1.0), score).alias("complexity"), "shapes", "kinds", "is_spiral", "layers")


def chroma_geometry(frames: DataFrame) -> DataFrame:
    """(piece_id, variance, eccentricity, circularity): mean variance of the twelve energies over a piece's frames, and how elongated they lie:
    from the two largest eigenvalues of their covariance, by moments alone.
    """
    e = lambda k: F.col("energy")[k]
    pairs = [(i, j) for i in range(12) for j in range(i, 12)]
    moments = frames.groupBy("piece_id").agg(F.count("*").alias("n"), *[F.covar_pop(e(i), e(j)).alias(f"c{i}_{j}") for i, j in pairs])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.to_dict("records"):
                c = np.zeros((12, 12))
                for i, j in pairs:
                    c[i, j] = c[j, i] = r[f"c{i}_{j}"]
                second, first = np.linalg.eigvalsh(c)[-2:]
                long = float(np.sqrt(max(0.0, 1 - (second / first) ** 2))) if first > 1e-12 else 0.0
                rows.append((r["piece_id"], float(np.trace(c) / 12), long, 1 - long))
            yield _frame(rows, {"piece_id": "int64", "variance": "float64", "eccentricity": "float64", "circularity": "float64"})

    return moments.mapInPandas(run, "piece_id bigint, variance double, eccentricity double, circularity double")


def _key(energy: np.ndarray) -> tuple[str, float]:
    """Best of the 24 keys in the order C major, C minor, C# major, and so on; the strength is at least 0."""
    centred = energy - energy.mean()
    length = np.linalg.norm(centred)
    if length < 1e-12:
        return "C major", 0.0
    profiles = dict(keys())
    ordered = [f"{n} {mode}" for n in NAMES for mode in ("major", "minor")]
    scores = [float(centred @ np.array(profiles[k]) / length) for k in ordered]
    best = int(np.argmax(np.round(scores, 12)))
    return ordered[best], max(0.0, scores[best])


def key_segments(frames: DataFrame, window: int = 8, step: int = 2, least: int = 2, seconds: float = 4.0) -> DataFrame:
    """(piece_id, segment, start_frame, end_frame, start_time, key, strength): a window's key, grown by ``step`` frames while they have the
    same key and a strength over 0.3. Windows are in frames; missing frames are silent.
    """
    columns = {
        "piece_id": "int64", "segment": "int32", "start_frame": "int32", "end_frame": "int32", "start_time": "float64", "key": "object",
        "strength": "float64"
    }

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        chroma = np.zeros((int(piece["frame"].max()) + 1, 12))
        chroma[piece["frame"].to_numpy()] = np.stack(piece["energy"].to_list())
        rows, at = [], 0
        while at < len(chroma):
            end = min(at + window, len(chroma))
            key, strength = _key(chroma[at:end].mean(axis=0))
            begin = at
            while end < len(chroma):
                further, sure = _key(chroma[end : end + step].mean(axis=0))
                if further != key or sure <= 0.3:
                    break
                end = min(end + step, len(chroma))
            if end - begin >= least:
                rows.append((piece["piece_id"].iloc[0], len(rows), begin, end, begin * seconds, key, strength))
            at = end
        return _frame(rows, columns)

    return frames.groupBy("piece_id").applyInPandas(
        run, "piece_id bigint, segment int, start_frame int, end_frame int, start_time double, key string, strength double"
    )


def modulations(segments: DataFrame) -> DataFrame:
    """(piece_id, time, from_key, to_key, distance, kind, confidence): changes of key between successive segments; up to one step on the circle
    of fifths is diatonic, up to three chromatic, else distant.
    """
    order = Window.partitionBy("piece_id").orderBy("segment")
    steps = segments.select(
        "piece_id", F.col("key").alias("from_key"), "strength",
        *[F.lead(c).over(order).alias(n) for c, n in (("key", "to_key"), ("start_time", "time"), ("strength", "next"))]
    ).where(F.col("to_key") != F.col("from_key"))
    root = lambda c: F.array_position(F.array(*[F.lit(n) for n in NAMES]), F.substring_index(c, " ", 1)) - 1
    rows = steps.withColumn("distance", fifths_distance(root("from_key"), root("to_key")).cast("int"))
    return rows.select(
        "piece_id", "time", "from_key", "to_key", "distance",
        F.when(F.col("distance") <= 1, "diatonic").when(F.col("distance") <= 3, "chromatic").otherwise("distant").alias("kind"),
        ((F.col("strength") + F.col("next")) / 2).alias("confidence")
    )


def chroma_cycles(frames: DataFrame, seconds: float = 4.0, most: int = 10) -> DataFrame:
    """(piece_id, kind, number, frame, value): in order of length and start, at most ``most`` of each kind: adjacent blocks of Fibonacci length
    with a cosine over 0.8, prime gaps between frames with a peak over 0.5, and large changes of mean energy within 5 % of a golden position
    (at most five).
    """

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        chroma = np.zeros((int(piece["frame"].max()) + 1, 12))
        chroma[piece["frame"].to_numpy()] = np.stack(piece["energy"].to_list())
        n, repeats = len(chroma), []
        for size in (1, 2, 3, 5, 8, 13, 21, 34):
            for at in range(n - 2 * size if size < n else 0):
                a, b = chroma[at : at + size].ravel(), chroma[at + size : at + 2 * size].ravel()
                length = np.linalg.norm(a) * np.linalg.norm(b)
                if length > 0 and a @ b / length > 0.8:
                    repeats.append(("fibonacci", size, at, float(a @ b / length)))
        peaks = np.flatnonzero(chroma.max(axis=1) > 0.5)
        gaps = [("prime", int(g), int(p), float(g)) for p, g in zip(peaks, np.diff(peaks)) if g in (2, 3, 5, 7, 11, 13, 17, 19, 23)]
        change = np.diff(chroma.mean(axis=1))
        large = np.flatnonzero(np.abs(change) > change.std()) if len(change) else []
        golden = [("golden", 0, int(k), float(k / n)) for k in large if min(abs(k / n - g) for g in (1 / PHI, 1 / PHI**2)) < 0.05]
        rows = [(piece["piece_id"].iloc[0], *r) for r in repeats[:most] + gaps[:most] + golden[:5]]
        return _frame(rows, {"piece_id": "int64", "kind": "object", "number": "int32", "frame": "int32", "value": "float64"})

    return frames.groupBy("piece_id").applyInPandas(run, "piece_id bigint, kind string, number int, frame int, value double")


def generation_quality(matrix_like: DataFrame, low: float = 2.0, high: float = 2.6) -> DataFrame:
    """(piece_id, quality, passes): entropy in a band, variety of interval sizes out of 13 and a range of one to three octaves, weighted .3,
    .25 and .45; 0.65 passes. Input: notes.
    """
    from .features import _pitch, with_steps

    rows = with_steps(matrix_like).groupBy("piece_id").agg(
        _pitch()[0], (F.max("pitch") - F.min("pitch")).alias("r"), F.count_distinct(F.abs("iv")).alias("v")
    )
    e = F.col("pitch_entropy")
    inside = F.when((e >= low) & (e <= high), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.abs(e - low), F.abs(e - high)) / 0.5))
    reach = F.when(F.col("r").between(12, 36), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("r") - 24) / 24))
    score = inside * 0.3 + F.least(F.col("v") / 13, F.lit(1.0)) * 0.25 + reach * 0.45
    return rows.select("piece_id", score.alias("quality"), (score >= 0.65).alias("passes"))
