"""Chords, keys, palindromes and mirrors.

Grouping chords by their first onset and picking matches that do not overlap are sequential by nature; they run in numpy on one piece at a
time. What needs no such choice is window functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_seq

#: Degrees of the major and the natural minor scale.
MAJOR, MINOR = (0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)
NUMERALS = ("I", "II", "III", "IV", "V", "VI", "VII")


def chord_of(pitches: list[int], extended: bool = False) -> tuple[int, str] | None:
    """(root, quality) of the first root in ascending order with a third and a fifth. Only extended knows other triads than major and minor,
    and sevenths.
    """
    classes = sorted({p % 12 for p in pitches})
    kinds = [("major", {4, 7}), ("minor", {3, 7})]
    if extended:
        kinds = [("major7", {4, 7, 11}), ("dominant7", {4, 7, 10}), ("minor7", {3, 7, 10}), *kinds, ("diminished", {3, 6}), ("augmented", {4, 8})]
    for root in classes if len(classes) > 1 else []:
        above = {(c - root) % 12 for c in classes}
        for name, need in kinds:
            if need <= above:
                return root, name
    return None


def key_of(roots: list[int]) -> tuple[int, bool]:
    """(tonic, minor) with the best score: 1 for a root in the scale, 2 more for the fifth, 3 more for the tonic. First best wins, major before
    minor.
    """
    best = (0, False, -1)
    for tonic in range(12):
        for minor, scale in ((False, MAJOR), (True, MINOR)):
            steps = [(r - tonic) % 12 for r in roots]
            score = sum((s in scale) + 2 * (s == 7) + 3 * (s == 0) for s in steps)
            if score > best[2] and roots:
                best = (tonic, minor, score)
    return best[:2]


def numeral(root: int, quality: str, tonic: int, minor: bool) -> str:
    """Degree of a chord in a key; lower case for minor chords, the semitone number outside the scale."""
    step, scale = (root - tonic) % 12, MINOR if minor else MAJOR
    if step not in scale:
        return str(step)
    name = NUMERALS[scale.index(step)]
    return {
        "minor": name.lower(), "minor7": name.lower() + "7", "diminished": name.lower() + "°", "augmented": name + "+", "dominant7": name + "7",
        "major7": name + "maj7"
    }.get(quality, name)


def chords(notes: DataFrame, window: float = 0.1, extended: bool = False) -> DataFrame:
    """(piece_id, position, time, root, quality, numeral, tonic, is_minor): notes within ``window`` of a group's first onset form a group;
    groups that are no chord, and repeats of the chord before, are left out.
    """

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values(["start", "seq"])
        found, begin, group = [], None, []
        for start, pitch in [*zip(piece["start"].tolist(), piece["pitch"].tolist()), (float("inf"), 0)]:
            if begin is not None and start - begin > window:
                chord = chord_of(group, extended)
                if chord and (not found or found[-1][1:] != chord):
                    found.append((begin, *chord))
                begin = None
            if begin is None:
                begin, group = start, []
            group.append(pitch)
        tonic, minor = key_of([r for _, r, _ in found])
        rows = [(piece["piece_id"].iloc[0], k, t, r, q, numeral(r, q, tonic, minor), tonic, minor) for k, (t, r, q) in enumerate(found)]
        out = pd.DataFrame(rows, columns=["piece_id", "position", "time", "root", "quality", "numeral", "tonic", "is_minor"])
        return out.astype(
            {"piece_id": "int64", "position": "int32", "time": "float64", "root": "int32", "quality": "object", "numeral": "object", "tonic": "int32", "is_minor": "bool"}
        )

    return notes.select("piece_id", "seq", "start", "pitch").groupBy("piece_id").applyInPandas(
        run, "piece_id bigint, position int, time double, root int, quality string, numeral string, tonic int, is_minor boolean"
    )


#: Named progressions.
PROGRESSIONS = {
    "authentic": "V I", "plagal": "IV I", "two_five_one": "II V I", "pop": "I V VI IV", "doo_wop": "I VI IV V", "blues": "I IV V",
    "circle": "VI II V I"
}


def progression_patterns(found: DataFrame) -> DataFrame:
    """(piece_id, pattern, hits, frequency) of named progressions in a piece's numerals without quality; frequency is hits / max(1, chords /
    length).
    """
    plain = found.select("piece_id", "position", F.upper(F.regexp_replace("numeral", r"[°+]|maj7|7$", "")).alias("n"))
    w = Window.partitionBy("piece_id").orderBy("position")
    runs = plain.select(
        "piece_id", *[F.lead("n", k).over(w).alias(f"n{k}") for k in range(4)], F.count("*").over(Window.partitionBy("piece_id")).alias("total")
    )
    grams = F.explode(
        F.array(
            *[F.struct(F.when(F.col(f"n{k - 1}").isNotNull(), F.concat_ws(" ", *[F.col(f"n{i}") for i in range(k)])).alias("run"), F.lit(k).alias("length")) for k in (2, 3, 4)]
        )
    )
    rows = runs.select("piece_id", "total", grams.alias("g")).select("piece_id", "total", "g.*").where(F.col("run").isNotNull())
    names = F.create_map(*[F.lit(x) for name, run in PROGRESSIONS.items() for x in (run, name)])
    named = rows.withColumn("pattern", names[F.col("run")]).where(F.col("pattern").isNotNull())
    return named.groupBy("piece_id", "pattern", "length").agg(
        F.count("*").alias("hits"), (F.count("*") / F.greatest(F.lit(1.0), F.max("total") / F.col("length"))).alias("frequency")
    ).drop("length")


def progression_complexity(found: DataFrame) -> DataFrame:
    """(piece_id, complexity, unique_chords, uniqueness_ratio, change_rate, non_tonic_ratio, roman_diversity) of pieces with two chords or more."""
    n, span = F.count("*"), F.max("time") - F.min("time")
    rows = found.groupBy("piece_id").agg(
        n.alias("_n"), F.count_distinct("root", "quality").alias("unique_chords"),
        F.when(span > 0, (n - 1) / span).otherwise(0.0).alias("change_rate"),
        F.avg(F.when(F.col("root") != F.col("tonic"), 1.0).otherwise(0.0)).alias("non_tonic_ratio"), F.count_distinct("numeral").alias("_numerals"),
    ).where("_n >= 2")
    rows = rows.withColumns(
        {"uniqueness_ratio": F.col("unique_chords") / F.col("_n"), "roman_diversity": F.col("_numerals") / F.least(F.col("_n"), F.lit(7))}
    )
    score = F.col("uniqueness_ratio") * 0.3 + F.least(
        F.col("change_rate") / 2, F.lit(1.0)
    ) * 0.2 + F.col("non_tonic_ratio") * 0.3 + F.col("roman_diversity") * 0.2
    return rows.select(
        "piece_id", score.alias("complexity"), "unique_chords", "uniqueness_ratio", "change_rate", "non_tonic_ratio", "roman_diversity"
    )


def palindrome_features(notes: DataFrame, window: int = 8) -> DataFrame:
    """(piece_id, counts of melodic, rhythmic and intervallic palindromes and of mirrors, density, longest melodic and rhythmic,
    has_retrograde, symmetry).
    """
    kinds = ("melodic", "rhythmic", "intervallic")
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in kinds]
    longest = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("length"))), F.lit(0)).alias(f"longest_{k}") for k in kinds[:2]]
    found = palindromes(notes).groupBy("piece_id").agg(*counts, *longest, F.sum("length").alias("_covered"))
    mirrors = structural_mirrors(notes).groupBy("piece_id").agg(F.count("*").alias("mirror_count"))
    n = notes.groupBy("piece_id").agg(F.count("*").alias("_n"))
    rows = n.join(found, "piece_id", "left").join(mirrors, "piece_id", "left").na.fill(0)
    rows = rows.join(retrograde_motion(notes, window), "piece_id").join(symmetry_score(notes), "piece_id")
    return rows.withColumn("density", F.col("_covered") / F.col("_n")).drop("_covered", "_n")


def _radii(n: int, odd: bool, most: int, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """How far values answer each other around each centre, up to ``most`` on either side: centre c is the value c, or the gap before it. Centres that
    have stopped are not looked at again, so that the work is that of the palindromes there are.
    """
    radii, alive = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for r in range(most):
        a, b = alive - 1 - r, alive + r + odd
        inside = (a >= 0) & (b < n)
        alive = alive[inside]
        alive = alive[same(a[inside], b[inside])]
        if not len(alive):
            break
        radii[alive] += 1
    return radii


def _starts(radii: tuple[np.ndarray, np.ndarray], length: int, n: int) -> np.ndarray:
    """Starts of the windows of this length that answer themselves, from the radii of gaps and of values."""
    half = length // 2
    starts = np.flatnonzero(radii[length % 2] >= half) - half
    return starts[(starts >= 0) & (starts + length <= n)]


def _apart(radii: tuple[np.ndarray, np.ndarray], n: int, least: int, most_length: int, most: int) -> list[tuple[int, int]]:
    """The first ``most`` (start, length) of palindromes, longest first and then in order, without overlaps."""
    used, out = np.zeros(n, bool), []
    for length in range(min(n, most_length), least - 1, -1):
        for start in _starts(radii, length, n).tolist():
            if not used[start : start + length].any():
                used[start : start + length] = True
                out.append((start, length))
                if len(out) == most:
                    return out
    return out


def palindromes(notes: DataFrame, least: int = 4, most_length: int = 49, most: int = 20, tolerance: int = 0, ratio: float = 0.1) -> DataFrame:
    """(piece_id, kind, start, length): melodic and rhythmic palindromes without overlaps, and intervallic ones (intervals that answer in
    reverse with opposite sign; a middle interval is free) in order of length and start, at most 15.

    Found from their centres, with work and memory in proportion to a piece's notes and its palindromes.
    """

    def both(n: int, length: int, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return _radii(n, False, length // 2, same), _radii(n, True, length // 2, same)

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("seq")
        pitch, duration = piece["pitch"].to_numpy(), piece["duration"].to_numpy()
        steps, n, rows = np.diff(pitch), len(pitch), []
        melodic = both(n, most_length, lambda a, b: np.abs(pitch[a] - pitch[b]) <= tolerance)
        rhythmic = both(n, most_length, lambda a, b: np.abs(duration[a] - duration[b]) <= ratio * np.maximum(duration[a], duration[b]))
        for kind, radii in (("melodic", melodic), ("rhythmic", rhythmic)):
            rows += [(kind, s, k) for s, k in _apart(radii, n, least, most_length, most)]
        answers, radii = [], both(len(steps), 29, lambda a, b: steps[a] == -steps[b])
        for k in range(3, min(len(steps), 29) + 1):
            answers += [(s, k + 1) for s in _starts(radii, k, len(steps))[:15].tolist()]
            if len(answers) >= 15:
                break
        rows += [("intervallic", s, k) for s, k in answers[:15]]
        out = pd.DataFrame([(piece["piece_id"].iloc[0], *r) for r in rows], columns=["piece_id", "kind", "start", "length"])
        return out.astype({"piece_id": "int64", "kind": "object", "start": "int32", "length": "int32"})

    return notes.select("piece_id", "seq", "pitch", "duration").groupBy("piece_id").applyInPandas(
        run, "piece_id bigint, kind string, start int, length int"
    )


def _section_pairs(x: np.ndarray, least: int, most: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For sections of each length that begin at each place: the best rounded share of positions in which they agree with an earlier section, -1 if it
    is below the threshold, and where the first such section begins.

    One running sum of agreements for each lag gives the sections of all lengths. A section of 2 * least values or more can be cut into sections of
    ``least`` to 2 * least - 1, one of which agrees as well, so lags without such short ones are left at once.
    """
    n = len(x)
    score, first = np.full((most + 1, n), -1.0), np.zeros((most + 1, n), np.int64)
    rounded = [np.array([round(k / max(size, 1), 3) for k in range(size + 1)]) for size in range(most + 1)]
    for lag in range(least, n - least + 1):
        sums = np.concatenate([[0], np.cumsum(x[:-lag] == x[lag:])])
        found = False
        for size in range(least, min(most, lag, n - lag) + 1):
            if size == 2 * least and not found:
                break
            alike = sums[size:] - sums[:-size]
            hits = np.flatnonzero(alike / size >= threshold)
            if len(hits):
                found, b, now = True, hits + lag, rounded[size][alike[hits]]
                better = now >= score[size, b]  # lags rise, so that of equal ones the earliest section stays
                score[size, b[better]], first[size, b[better]] = now[better], hits[better]
    return score, first


def structural_mirrors(notes: DataFrame, least: int = 8, most_length: int = 99, threshold: float = 0.8, most: int = 10) -> DataFrame:
    """(piece_id, a_start, b_start, length, similarity, kind): section pairs that agree in at least ``threshold`` of their positions, best
    first, none of whose second sections overlap.

    Memory is that of the piece's notes times the lengths; the work is a pass over the piece for each lag.
    """

    def kind_of(a: np.ndarray, b: np.ndarray) -> str:
        if (a == b).all():
            return "exact"
        if (np.diff(a) == -np.diff(b)).all():
            return "inverted"
        return "retrograde" if (a == b[::-1]).all() else "approximate"

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        x, rows = piece.sort_values("seq")["pitch"].to_numpy(), []
        score, first = _section_pairs(x, least, min(len(x) // 2, most_length), threshold)
        sizes, seconds = np.nonzero(score >= 0)
        order = np.lexsort((seconds, first[sizes, seconds], sizes, -score[sizes, seconds]))
        used = np.zeros(len(x), bool)
        for n, b in zip(sizes[order].tolist(), seconds[order].tolist()):
            if not used[b : b + n].any():
                used[b : b + n] = True
                a = int(first[n, b])
                rows.append((piece["piece_id"].iloc[0], a, b, n, float(score[n, b]), kind_of(x[a : a + n], x[b : b + n])))
                if len(rows) == most:
                    break
        out = pd.DataFrame(rows, columns=["piece_id", "a_start", "b_start", "length", "similarity", "kind"])
        return out.astype({"piece_id": "int64", "a_start": "int32", "b_start": "int32", "length": "int32", "similarity": "float64", "kind": "object"})

    return notes.select("piece_id", "seq", "pitch").groupBy("piece_id").applyInPandas(
        run, "piece_id bigint, a_start int, b_start int, length int, similarity double, kind string"
    )


def retrograde_motion(notes: DataFrame, window: int = 8) -> DataFrame:
    """(piece_id, has_retrograde): whether any window is followed by its reverse."""
    frame = by_seq().rowsBetween(0, 2 * window - 1)
    runs = notes.select("piece_id", F.collect_list("pitch").over(frame).alias("w"))
    hit = (F.size("w") == 2 * window) & (F.slice("w", 1, window) == F.reverse(F.slice("w", window + 1, window)))
    return runs.groupBy("piece_id").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("has_retrograde"))


def symmetry_score(notes: DataFrame) -> DataFrame:
    """(piece_id, symmetry): coverage of melodic, rhythmic and intervallic palindromes by .3, .25 and .25 and up to .2 of mirrors by .2, at most 1."""
    found = palindromes(notes).groupBy("piece_id").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("length")).otherwise(0)).alias(k) for k in ("melodic", "rhythmic", "intervallic")]
    )
    mirrors = structural_mirrors(notes).groupBy("piece_id").agg(F.count("*").alias("mirrors"))
    n = notes.groupBy("piece_id").agg(F.count("*").alias("n")).join(found, "piece_id", "left").join(mirrors, "piece_id", "left").na.fill(0)
    score = (
        F.col("melodic") * 0.3 + F.col("rhythmic") * 0.25 + F.col("intervallic") * 0.25
    ) / F.col("n") + F.least(F.col("mirrors") * 0.1, F.lit(0.2)) * 0.2
    return n.select("piece_id", F.least(F.lit(1.0), score).alias("symmetry"))
