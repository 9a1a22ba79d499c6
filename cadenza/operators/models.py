"""Style constraints, next-note suggestions, seeded generation, and learned models over feature vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored
from . import forest
from .features import CONSONANCE

#: Per style the entropy band, least consonance, least step ratio, repetition target and fractal band.
STYLES = {
    "baroque": (1.8, 2.4, 0.7, 0.6, 0.5, 1.2, 1.6), "classical": (2.0, 2.6, 0.6, 0.5, 0.4, 1.3, 1.6), "romantic": (2.3, 3.0, 0.4, 0.4, 0.3, 1.4, 1.8),
    "late_romantic": (2.5, 3.2, 0.3, 0.35, 0.25, 1.5, 2.0),
}
PHI = (1 + math.sqrt(5)) / 2
#: Weights of the seven terms of a suggestion's score.
WEIGHTS = {"markov": 0.30, "kalman": 0.15, "consonance": 0.15, "tension": 0.10, "fibonacci": 0.10, "golden_position": 0.10, "beauty": 0.10}
FIBONACCI = (1, 2, 3, 5, 8, 13)


#: Rows, and values of rows, up to which every task has the whole table and grows trees of its own.
FOREST_ROWS, FOREST_CELLS = 1 << 20, 1 << 24
#: For larger tables: rows of a part, memory for the nodes that are split at a time (rows are read once for each time), and folds side by side.
PART_ROWS, FOREST_MB, PARALLEL_FOLDS = 100_000, 512, 5


def check_styles(matrix: DataFrame) -> DataFrame:
    """(piece_id, style, entropy_ok, consonance_ok, steps_ok, valid, distance): every piece against every style; styles are a constant of a few
    rows.
    """
    styles = F.explode(
        F.array(*[F.struct(F.lit(s).alias("style"), *[F.lit(float(v)).alias(f"p{k}") for k, v in enumerate(p)]) for s, p in STYLES.items()])
    ).alias("s")
    c = F.col
    rows = matrix.select(
        "piece_id", "pitch_entropy", "consonance_score", "step_ratio", "repetition_index", "fractal_dimension", styles
    ).select("*", "s.*")
    checks = {
        "entropy_ok": c("pitch_entropy").between(c("p0"), c("p1")), "consonance_ok": c("consonance_score") >= c("p2"),
        "steps_ok": c("step_ratio") >= c("p3")
    }
    distance = (
        F.abs(c("pitch_entropy") - (c("p0") + c("p1")) / 2) + F.abs(c("repetition_index") - c("p4")) + F.abs(
            c("fractal_dimension") - (c("p5") + c("p6")) / 2
        )
    ) / 3
    return rows.withColumns(checks).select(
        "piece_id", "style", *checks, (c("entropy_ok") & c("consonance_ok") & c("steps_ok")).alias("valid"), distance.alias("distance")
    )


def _suggest(
    pitches: np.ndarray, durations: np.ndarray, markov: np.ndarray, total: float, top: int, with_terms: bool = False
) -> list[tuple] | tuple[list[tuple], list[dict[str, float]]]:
    """(pitch, score, duration, tag) of the best next notes after a context of up to 16 notes; with_terms: and the seven terms of each."""
    recent, last = pitches[-16:], int(pitches[-1])
    level, variance = float(last), 1.0  # the filter starts at the last pitch and replays the context
    for x in recent:
        variance += 0.02
        gain = variance / (variance + 0.08)
        level, variance = level + gain * (x - level), (1 - gain) * variance
    candidates = np.arange(max(36, last - 24), min(97, last + 25))
    leap = np.abs(candidates - last)
    terms = {
        "markov": markov[last % 12, candidates % 12], "kalman": np.exp(-0.5 * ((candidates - level) / 6) ** 2),
        "consonance": np.array(CONSONANCE)[leap % 12]
    }
    position = len(pitches) / total if total > 0 else None
    eight = recent[-8:]
    if position is None:
        terms["tension"], terms["golden_position"] = np.full(len(leap), 0.5), np.full(len(leap), 0.5)
    else:
        target = np.clip(position / 0.618 if position <= 0.618 else 1 - (position - 0.618) / 0.382, 0, 1)
        terms["tension"] = np.full(len(leap), target) if len(recent) < 2 else 1 - np.abs(np.minimum(1, (np.ptp(eight) + leap) / 24) - target)
        terms["golden_position"] = np.full(len(leap), max(0.0, 1 - 5 * min(abs(position - g) for g in (1 / PHI, 1 / PHI**2, 1 - 1 / PHI))))
    nearest = np.abs(np.subtract.outer(leap, FIBONACCI)).min(axis=1)
    terms["fibonacci"] = np.where(np.isin(leap, FIBONACCI), 1.0, np.where(np.isin(leap % 12, FIBONACCI), 0.7, np.maximum(0, 1 - nearest / 12)))
    before = np.abs(np.diff(eight)) % 12
    beauty = []
    for step in leap % 12:
        steps = np.append(before, step)
        variety = len(set(steps.tolist())) / min(len(steps), 12)
        fit = 1 - abs(np.array(CONSONANCE)[steps].mean() - 0.65) * 2
        beauty.append(np.clip(0.4 * fit + 0.3 * (1 - abs(variety - 0.5) * 2) + 0.3 * (1 - variety), 0, 1))
    terms["beauty"] = np.array(beauty)
    score = sum(w * terms[k] for k, w in WEIGHTS.items())
    length, spread = float(durations[-8:][0]), 1.0
    for d in durations[-8:][1:]:
        gain = (spread + 0.05) / (spread + 0.15)
        length, spread = length + gain * (d - length), (1 - gain) * (spread + 0.05)

    def tag(k: int) -> str:
        t = {name: float(v[k]) for name, v in terms.items()}
        # fixed values: the tags and their thresholds, the first that holds
        rules = (
            ("dramatic_tension", t["tension"] > 0.8 and t["consonance"] < 0.4), ("golden_harmony", t["consonance"] > 0.8 and t["fibonacci"] > 0.7),
            ("structural_climax", t["golden_position"] > 0.8),
            ("natural_flow", t["beauty"] > 0.7 and t["markov"] > 0.3), ("peaceful_resolution", t["tension"] < 0.3 and t["consonance"] > 0.7),
            ("fibonacci_resonance", t["fibonacci"] > 0.8),
        )
        return next((name for name, holds in rules if holds), "neutral")

    best = np.argsort(-score, kind="stable")[:top]
    found = [(int(candidates[k]), float(score[k]), round(min(4.0, max(0.25, length)), 2), tag(int(k))) for k in best]
    return (found, [{name: float(v[k]) for name, v in terms.items()} for k in best]) if with_terms else found


def markov_matrix(notes: DataFrame) -> np.ndarray:
    """The pooled 12 x 12 pitch-class model; at most 144 rows come to the driver."""
    from .markov import pitch_class, transitions

    out = np.zeros((12, 12))
    for r in transitions(notes, pitch_class()).collect():
        out[r.src, r.dst] = r.p
    return out


def suggest_next(notes: DataFrame, markov: np.ndarray, top: int = 5, total: float = 100.0) -> DataFrame:
    """(piece_id, rank, pitch, score, duration, tag): the likeliest next notes of each piece, were it ``total`` notes long."""

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        piece = piece.sort_values("seq")
        rows = _suggest(piece["pitch"].to_numpy(), piece["duration"].to_numpy(), markov, total, top)
        return pd.DataFrame(
            [(piece["piece_id"].iloc[0], k + 1, *r) for k, r in enumerate(rows)], columns=["piece_id", "rank", "pitch", "score", "duration", "tag"]
        )

    return notes.select("piece_id", "seq", "pitch", "duration").groupBy("piece_id").applyInPandas(
        run, "piece_id bigint, rank int, pitch int, score double, duration double, tag string"
    )


def generate(
    spark: SparkSession, markov: np.ndarray, samples: int = 20, length: int = 64, start: int = 60, temperature: float = 1.0, seed: int = 42
) -> DataFrame:
    """(sample, seq, pitch, duration): seeded walks of a pitch-class chain; each sample has a generator of its own. A class without moves goes
    anywhere. The octave is the one from 3 to 6 next to the note before.
    """
    p = markov ** (1 / temperature)
    p = np.where(p.sum(axis=1, keepdims=True) > 0, p, 1.0)
    p = p / p.sum(axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample in batch.column(0).to_pylist():
                rng, pitch, rows = np.random.default_rng([seed, sample]), start, []
                for k in range(length):
                    rows.append((sample, k, pitch, float(rng.choice([0.25, 0.5, 1.0, 2.0], p=[0.2, 0.4, 0.3, 0.1]))))
                    step = int(rng.choice(12, p=p[pitch % 12]))
                    pitch = min((12 * (octave + 1) + step for octave in range(3, 7)), key=lambda x: abs(x - pitch))
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.float64()))],
                    ["sample", "seq", "pitch", "duration"]
                )

    return spark.range(samples).mapInArrow(run, "sample bigint, seq int, pitch int, duration double")


def principal_components(df: DataFrame, columns: list[str], k: int = 2, scale: bool = True) -> DataFrame:
    """df with pc1..pck: components of the population-scaled (or only centred) columns; the sign makes the largest loading positive. Only the
    covariance matrix, columns by columns, comes to the driver.
    """
    moments = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    ).first()
    n = len(columns)
    mean, deviation = np.array([moments[f"m{i}"] for i in range(n)]), np.array([moments[f"s{i}"] for i in range(n)])
    deviation = np.where(scale & (deviation > 0), deviation, 1.0)
    covariance = np.array([[moments[f"c{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) / np.outer(deviation, deviation)
    values, vectors = np.linalg.eigh(covariance)
    vectors = vectors[:, np.argsort(-values)[:k]]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    score = lambda j: sum(((F.col(c) - float(mean[i])) / float(deviation[i]) * float(vectors[i, j]) for i, c in enumerate(columns)), F.lit(0.0))
    return df.withColumns({f"pc{j + 1}": score(j) for j in range(k)})


def classify(
    df: DataFrame, columns: list[str], label: str, folds: int = 3, trees: int = 30, depth: int = 5, least: int = 8, seed: int = 42,
    id_col: str = "piece_id"
) -> DataFrame:
    """(label, predicted, n): confusion counts of a random forest over hash folds; classes of fewer than ``least`` rows are left out before
    anything is fitted, and with no class left the result is empty. A row whose fold leaves none to learn from is predicted null.

    Tables of up to FOREST_CELLS values are sent to every task, which grows some of the trees whole. The forests of larger ones are grown by Spark, whose jobs
    for a level of the trees are short, so folds are fitted side by side.
    """
    from pyspark.ml.feature import StringIndexer

    kept = df.where(F.col(label).isNotNull()).join(
        df.groupBy(label).count().where(F.col("count") >= least).select(label), label, "left_semi"
    ).na.fill(0.0, columns).select(
        F.col(label).cast("string").alias("label"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
        F.pmod(F.xxhash64(id_col), F.lit(folds)).cast("int").alias("fold"), F.xxhash64(id_col).alias("id")
    )
    kept = stored(kept)
    n = kept.count()
    if not n:
        return kept.select("label", F.col("label").alias("predicted"), F.lit(0).cast("bigint").alias("n"))
    indexed = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(kept)
    rows, labels = indexed.transform(kept), indexed.labels
    if n > FOREST_ROWS or n * max(len(columns), len(labels)) > FOREST_CELLS:
        return _judged_by_levels(rows, labels, n, folds, trees, depth, seed)
    summed = forest.votes(rows.select("id", "fold", F.col("y").cast("int").alias("y"), "x"), len(labels), folds, trees, depth, seed)
    names, most = F.array(*[F.lit(x) for x in labels]), F.array_max("votes")
    predicted = F.when(most > 0, F.get(names, (F.array_position("votes", most) - 1).cast("int")))
    return summed.select(F.get(names, F.col("y").cast("int")).alias("label"), predicted.alias("predicted")).groupBy("label", "predicted").agg(
        F.count("*").alias("n")
    )


def _judged_by_levels(rows: DataFrame, labels: list[str], n: int, folds: int, trees: int, depth: int, seed: int) -> DataFrame:
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString
    from pyspark.ml.functions import array_to_vector

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.withColumn("_x", array_to_vector("x")).select("label", "y", "_x", "fold", "id")
    rows = stored(rows.repartition(max(tasks, -(-n // PART_ROWS)), "id").sortWithinPartitions("id"))
    back = IndexToString(inputCol="prediction", outputCol="predicted", labels=labels)
    spark_forest = RandomForestClassifier(
        featuresCol="_x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=FOREST_MB, cacheNodeIds=True
    )

    def judged(k: int) -> DataFrame:
        model = spark_forest.fit(rows.where(F.col("fold") != k))
        part = back.transform(model.transform(rows.where(F.col("fold") == k)))
        return stored(part.groupBy("label", "predicted").agg(F.count("*").alias("n")))

    with ThreadPool(min(folds, PARALLEL_FOLDS)) as pool:
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(judged), range(folds))
    return reduce(DataFrame.unionByName, parts).groupBy("label", "predicted").agg(F.sum("n").alias("n"))
