"""Seeded composition: styled walks of a pitch-class chain over bars, with constraints and scales, and walks steered by an emotion.

Every sample has a generator of its own, made from the seed and the sample's number, so that results do not depend on where it runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored
from .features import CONSONANCE
from .models import STYLES, _suggest
from .reports import SCALES

#: Note lengths and their chances by style; other styles have those of "classical".
LENGTHS = {
    "baroque": ((0.5, 1.0, 1.5, 2.0), (0.3, 0.4, 0.15, 0.15)),
    "romantic": ((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), (0.1, 0.2, 0.1, 0.25, 0.15, 0.1, 0.05, 0.05)),
    "classical": ((0.5, 1.0, 1.5, 2.0), (0.25, 0.4, 0.2, 0.15)),
}
#: Least tempo and the one beyond the most, by style; 90 for others.
TEMPI = {"baroque": (60, 101), "classical": (80, 131), "romantic": (50, 111), "late_romantic": (55, 101)}
#: What a target emotion weighs suggestions by; others go by the score.
EMOTIONS = {"dramatic": ("tension",), "peaceful": ("consonance",), "mathematical": ("fibonacci", "golden_position"), "expressive": ("beauty",)}


def tempo(rng: np.random.Generator, style: str) -> int:
    return int(rng.integers(*TEMPI[style])) if style in TEMPI else 90


def octave_near(pitch_class: int, before: int, lowest: int = 3, highest: int = 6) -> int:
    """The octave, of 12 pitches each from 0, in which a pitch class is nearest to the pitch before; the lower of two equally near."""
    return min(range(lowest, highest + 1), key=lambda o: abs(pitch_class + 12 * o - before))


def chances(markov: np.ndarray, before: int, temperature: float = 1.0, key: str | None = None, boost: float = 1.5) -> np.ndarray:
    """The chances of the next pitch class. A class that nothing follows goes anywhere; with a key, classes of its scale weigh ``boost`` times
    as much.
    """
    p = markov[before % 12].astype(float)
    if not p.sum():
        p = np.ones(12)
    if temperature != 1.0:
        p = (p + 1e-8) ** (1.0 / temperature)
    if key is not None:
        p = p * np.where(np.isin(np.arange(12), SCALES.get(key, SCALES["C_major"])), boost, 1.0)
    return p / p.sum()


def walk(
    rng: np.random.Generator, markov: np.ndarray, style: str, bars: int = 32, tonic: int = 60, beats: int = 4, temperature: float = 1.0,
    key: str | None = None
) -> list[tuple[int, float, float]]:
    """(pitch, duration, start) until the bars are full; the last note is cut to fit. The walk begins at the tonic, which is not a note itself."""
    lengths, weights = LENGTHS.get(style, LENGTHS["classical"])
    pitch, at, total, notes = tonic, 0.0, float(bars * beats), []
    while at < total and len(notes) < int(total * 3):
        step = int(rng.choice(12, p=chances(markov, pitch, temperature, key)))
        pitch = step + 12 * octave_near(step, pitch)
        duration = min(float(rng.choice(lengths, p=weights)), total - at)
        notes.append((pitch, duration, at))
        at += duration
    return notes


def summary(pitches: Sequence[int]) -> tuple[float, float, float]:
    """Pitch-class entropy, consonance and share of steps of up to two semitones."""
    counts = np.bincount(np.asarray(pitches) % 12, minlength=12)
    p = counts[counts > 0] / counts.sum()
    steps = np.abs(np.diff(pitches))
    return float(-(p * np.log2(p)).sum()), float(
        np.array(CONSONANCE)[steps % 12].mean()
    ) if len(steps) else 0.0, float((steps <= 2).mean()) if len(steps) else 0.0


def meets(style: str, features: tuple[float, float, float]) -> bool:
    """Whether entropy, consonance and steps are within a style's bounds; a style without any takes all."""
    bounds = STYLES.get(style)
    return bounds is None or (bounds[0] <= features[0] <= bounds[1] and features[1] >= bounds[2] and features[2] >= bounds[3])


def constrained(
    rng: np.random.Generator, markov: np.ndarray, style: str, attempts: int = 10, **options: int | str | None
) -> tuple[list[tuple[int, float, float]], bool]:
    """The first walk of ten notes or more that meets its style, hotter by a tenth at each attempt; else the last of ten notes or more, else a
    plain one.
    """
    last: list[tuple[int, float, float]] = []
    for k in range(attempts):
        notes = walk(rng, markov, style, temperature=1.0 + 0.1 * k, **options)
        if len(notes) >= 10:
            last = notes
            if meets(style, summary([n[0] for n in notes])):
                return notes, True
    return last or walk(rng, markov, style, **options), False


def _samples(
    spark: SparkSession, samples: int, seed: int, make: Callable[[np.random.Generator], list[tuple]], names: Sequence[str],
    kinds: Sequence[pa.DataType], schema: str
) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample in batch.column(0).to_pylist():
                rows = [(sample, k, *r) for k, r in enumerate(make(np.random.default_rng([seed, sample])))]
                columns = zip(*rows) if rows else [[]] * (len(names) + 2)
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *kinds))], ["sample", "seq", *names])

    return spark.range(samples).mapInArrow(run, f"sample bigint, seq int, {schema}")


def compose(
    spark: SparkSession, markov: np.ndarray, style: str = "classical", samples: int = 10, bars: int = 32, tonic: int = 60, key: str | None = None,
    seed: int = 42
) -> DataFrame:
    """(sample, seq, pitch, duration, start, tempo, meets_style): walks under their style's constraints."""

    def make(rng: np.random.Generator) -> list[tuple]:
        speed = tempo(rng, style)
        notes, fine = constrained(rng, markov, style, bars=bars, tonic=tonic, key=key)
        return [(*n, speed, fine) for n in notes]

    kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.bool_())
    return _samples(
        spark, samples, seed, make, ("pitch", "duration", "start", "tempo", "meets_style"), kinds,
        "pitch int, duration double, start double, tempo int, meets_style boolean"
    )


def emotional(
    spark: SparkSession, markov: np.ndarray, emotion: str = "balanced", samples: int = 5, length: int = 32, start: int = 60, seed: int = 42
) -> DataFrame:
    """(sample, seq, pitch, duration, tag): each next note is drawn from the five best suggestions, by the terms of the emotion or else by score."""

    def make(rng: np.random.Generator) -> list[tuple]:
        pitches, durations, rows = [start], [1.0], []
        for _ in range(length):
            best, terms = _suggest(np.array(pitches), np.array(durations), markov, 2.0 * length, 5, True)
            wanted = EMOTIONS.get(emotion)
            weights = [max(1e-8, float(np.mean([t[w] for w in wanted])) if wanted else b[1]) for b, t in zip(best, terms)]
            chosen = best[int(rng.choice(len(best), p=np.array(weights) / sum(weights)))]
            pitches.append(chosen[0])
            durations.append(chosen[2])
            rows.append((chosen[0], chosen[2], chosen[3]))
        return rows

    return _samples(
        spark, samples, seed, make, ("pitch", "duration", "tag"), (pa.int32(), pa.float64(), pa.string()), "pitch int, duration double, tag string"
    )


def forecast(smoothed: DataFrame, steps: int = 1, column: str = "value") -> DataFrame:
    """(piece_id, step, and the column): the last smoothed level of each piece, repeated: a level without a trend forecasts itself."""
    last = smoothed.groupBy("piece_id").agg(F.max_by(column, "seq").alias(column))
    return last.select("piece_id", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), column)


def ward_chain(means: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float, int]]:
    """(left, right, squared distance, size) of Ward's clustering of clustering features (a mean and how many rows it stands for), nearest first.
    Inputs are numbered from 0, and what comes of merge k is len(means) + k.

    By chains of nearest neighbours (Murtagh, "A Survey of Recent Advances in Hierarchical Clustering Algorithms", 1983): memory is that of
    the features alone, time that of a pass over them for each merge. Ties go to the lower number.
    """
    n = len(means)
    mean, size, alive = means.astype(float).copy(), sizes.astype(float).copy(), np.ones(n, bool)
    found, chain, low = [], [], 0  # (distance, one member of each side)
    while len(found) < n - 1:
        if not chain:
            while not alive[low]:
                low += 1
            chain = [low]
        at = chain[-1]
        live = np.flatnonzero(alive)
        d = 2 * size[at] * size[live] / (size[at] + size[live]) * ((mean[live] - mean[at]) ** 2).sum(axis=1)
        d[live == at] = np.inf
        least = d.min()
        near = live[np.flatnonzero(np.round(d, 9) <= round(least, 9))]
        to = chain[-2] if len(chain) > 1 and chain[-2] in near else int(near[0])
        if len(chain) > 1 and to == chain[-2]:
            a, b = min(at, to), max(at, to)
            found.append((float(least), a, b))
            mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
            del chain[-2:]
        else:
            chain.append(to)
    # in order of distance; a feature's number is that of the merge it is in by then
    order, top, out = sorted(range(n - 1), key=lambda k: (round(found[k][0], 9), k)), list(range(n)), []
    count = sizes.astype(float).tolist()
    number = list(range(n))

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for step, k in enumerate(order):
        d, a, b = found[k]
        a, b = root(a), root(b)
        left, right = sorted((number[a], number[b]))
        top[b], number[a] = a, n + step
        count[a] += count[b]
        out.append((left, right, d, int(count[a])))
    return out


def ward_merges(means: pd.DataFrame, names: Sequence[str]) -> list[tuple[int, str, str, float, int]]:
    """(step, left, right, distance, size) of agglomerative clustering by least increase of squared deviation."""
    n = len(names)
    name = lambda k: names[k] if k < n else f"#{k - n}"
    merges = ward_chain(means.to_numpy(float), np.ones(n))
    return [(step, name(a), name(b), float(np.sqrt(d)), size) for step, (a, b, d, size) in enumerate(merges)]


def _cells(means: DataFrame, columns: Sequence[str], cells: int, cell_groups: int, seed: int) -> DataFrame:
    """means with _cell: k-means cells, those of more groups than a cell may have dealt on by a hash of their names."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(means)
    placed = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="_x", predictionCol="_k").fit(rows).transform(rows).drop("_x")
    sizes = placed.groupBy("_k").agg(F.ceil(F.count("*") / cell_groups).alias("_parts"))
    placed = placed.join(F.broadcast(sizes), "_k").withColumn("_part", F.pmod(F.xxhash64("_name"), F.col("_parts")))
    return placed.withColumn("_cell", F.concat_ws("/", "_k", "_part")).drop("_k", "_parts", "_part")


def hierarchy(matrix: DataFrame, by: str, columns: Sequence[str], most_groups: int = 2000, seed: int = 42) -> DataFrame:
    """(step, left, right, distance, size): Ward's clustering of the groups' mean standardised features; a group that came of step k is named #k.

    Up to ``most_groups`` groups are one tree. More are dealt to cells of at most so many near ones, each of which becomes a tree in a task of its own;
    the cells' clustering features, which are few, are clustered in turn, so that no task and not the driver holds all groups. Steps are then numbered
    cell by cell, and those that join cells come last.
    """
    spark, columns = matrix.sparkSession, list(columns)
    spread = matrix.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    scaled = [((F.avg(c) - F.lit(spread[f"m{i}"])) / F.lit(spread[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(columns)]
    means = matrix.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_name")).agg(*scaled)
    schema = "step int, left string, right string, distance double, size int"
    head = means.orderBy("_name").limit(most_groups + 1).toPandas()
    if len(head) <= most_groups:
        return spark.createDataFrame(ward_merges(head[columns], head["_name"].tolist()), schema)
    means = stored(means)
    cells = stored(_cells(means, columns, -(-2 * means.count() // most_groups), most_groups, seed))

    def tree(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("_name")
        rows = ward_merges(cell[columns], [f"={x}" for x in cell["_name"]])
        out = pd.DataFrame(rows, columns=["step", "left", "right", "distance", "size"])
        return out.assign(_cell=cell["_cell"].iloc[0])[["_cell", "step", "left", "right", "distance", "size"]].astype({"step": "int32", "size": "int32", "distance": "float64"})

    inner = stored(cells.groupBy("_cell").applyInPandas(tree, f"_cell string, {schema}"))
    features = cells.groupBy("_cell").agg(F.count("*").alias("_n"), F.min("_name").cast("string").alias("_first"), *[F.avg(c).alias(c) for c in columns]).orderBy("_cell").toPandas()
    begins = np.concatenate([[0], np.cumsum(features["_n"].to_numpy() - 1)]).tolist()
    offset = spark.createDataFrame(list(zip(features["_cell"].tolist(), begins)), "_cell string, _begin int")

    def moved(name: str) -> Column:
        return F.when(F.col(name).startswith("#"), F.concat(F.lit("#"), F.substring(name, 2, 20).cast("int") + F.col("_begin"))).otherwise(F.expr(f"substring(`{name}`, 2)"))

    low = inner.join(F.broadcast(offset), "_cell").select((F.col("step") + F.col("_begin")).alias("step"), moved("left").alias("left"), moved("right").alias("right"), "distance", "size")
    n = len(features)
    own = [f"#{b + int(c) - 2}" if c > 1 else f for b, c, f in zip(begins, features["_n"], features["_first"])]
    name = lambda k: own[k] if k < n else f"#{begins[-1] + k - n}"
    joins = ward_chain(features[columns].to_numpy(float), features["_n"].to_numpy())
    high = [(begins[-1] + k, name(a), name(b), float(np.sqrt(d)), size) for k, (a, b, d, size) in enumerate(joins)]
    return low.unionByName(spark.createDataFrame(high, schema))


def feature_importance(
    matrix: DataFrame, columns: Sequence[str], label: str, trees: int = 100, depth: int = 10, top: int = 20, seed: int = 42
) -> DataFrame:
    """(rank, feature, importance): the ``top`` features of a random forest that tells the labels apart; ties by name."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    kept = matrix.where(F.col(label).isNotNull()).na.fill(0.0, list(columns))
    indexed = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(kept).transform(kept)
    rows = VectorAssembler(inputCols=list(columns), outputCol="_x").transform(indexed)
    found = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed).fit(rows).featureImportances.toArray()
    ranked = sorted(zip(columns, found.tolist()), key=lambda f: (-f[1], f[0]))[:top]
    return matrix.sparkSession.createDataFrame(
        [(k + 1, c, float(v)) for k, (c, v) in enumerate(ranked)], "rank int, feature string, importance double"
    )
