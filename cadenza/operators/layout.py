"""Layouts in the plane that keep neighbourhoods: a neighbour graph, affinities of a given perplexity, and a seeded descent in rounds.

The graph comes from the lists of the index of nearest neighbours. Each row's affinities to its neighbours are those of a Gaussian whose width gives the wanted
perplexity, found by bisection for many rows at once. Positions begin at the first two principal directions of a bounded sample and
follow the gradient of t-SNE (van der Maaten and Hinton, 2008): neighbours attract, and all rows repel each other, by a seeded sample of
positions in place of all (as in negative sampling; Tang, Liu, Zhang and Mei, "Visualizing Large-scale and High-dimensional Data", 2016).

Rows are dealt to blocks by the index's lists, which hold most of a row's neighbours, and lists of many rows are cut further. In a round each
block moves its rows by many steps in one task; neighbours in the block are where they are at each step, others, and the sample of the other
blocks' rows, where they were when the round began. What does not change is worked out once: which rows a block must hear of from each other
block, and the place in what it hears of each neighbour. After a round each block sends to each other the positions it waits for, as one row, so
that no edge is joined or shuffled again. A row has a bounded number of neighbours, so no row that many others are near to makes a large group.

Vectors without a direction are neighbours of none and are laid out by repulsion alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import stored
from . import neighbours

#: Rows of a block on average, positions of the sample by which rows repel each other, and how many of them a step takes.
BLOCK_ROWS, SAMPLE, STEP_SAMPLE = 4096, 2048, 256
#: Rounds, steps of a round, rounds with exaggerated attraction, and by how much.
ROUNDS, STEPS, EARLY, EXAGGERATION = 8, 30, 2, 12.0


def affinities(squared: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows of affinities that sum to 1 from rows of squared distances (infinite where there is none), with this perplexity or that of all alike."""
    least = squared.min(axis=1, keepdims=True)
    apart = np.where(np.isfinite(squared), squared - np.where(np.isfinite(least), least, 0), np.inf)
    finite = np.where(np.isfinite(apart), apart, 0.0)
    low, high, beta = np.zeros(len(apart)), np.full(len(apart), np.inf), np.ones(len(apart))
    for _ in range(60):
        w = np.exp(-beta[:, None] * finite) * np.isfinite(apart)
        total = np.maximum(w.sum(axis=1), 1e-300)
        flat = np.log(total) + beta * (w * finite).sum(axis=1) / total > np.log(perplexity)
        low, high = np.where(flat, beta, low), np.where(flat, high, beta)
        beta = np.where(np.isinf(high), np.minimum(beta * 2, 1e12), (low + high) / 2)
    w = np.exp(-beta[:, None] * finite) * np.isfinite(apart)
    return w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300)


def graph(vectors: DataFrame, model: neighbours.Model, perplexity: float, near: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, near, weight): the neighbours of each row that has any, and its affinities to them."""
    listed = neighbours.neighbours_of_all(vectors, model, near, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(x) for x in batch.column(2).to_pylist()]
            squared = np.full((len(rows), near), np.inf)
            for line, scores in zip(squared, rows):
                line[: len(scores)] = 2 - 2 * scores
            weights = affinities(squared, perplexity)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array([w[: len(s)] for w, s in zip(weights, rows)], pa.list_(pa.float32()))], ["id", "near", "weight"]
            )

    return listed.mapInArrow(run, f"id {kind}, near array<{kind}>, weight array<float>")


def principal(vectors: DataFrame, width: int, id_col: str, vector_col: str, rows: int = neighbours.FIT_ROWS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions): the first two principal directions of at most ``rows`` vectors of unit length, those of the least seeded hash."""
    sample = vectors.select(F.col(vector_col).alias("v")).orderBy(F.xxhash64(F.lit(seed), F.col(id_col))).limit(rows).toArrow()
    x = neighbours.matrix(sample.column("v"), width)
    mean = x.mean(axis=0) if len(x) else np.zeros(width)
    directions = np.linalg.svd(x - mean, full_matrices=False)[2][:2] if len(x) else np.zeros((2, width))
    directions = np.concatenate([directions, np.zeros((2 - len(directions), width))]) if len(directions) < 2 else directions
    turned = np.sign(directions[np.arange(2), np.abs(directions).argmax(axis=1)])  # signs are free: the largest part is positive
    return mean, directions * np.where(turned == 0, 1, turned)[:, None]


def descend(
    y: np.ndarray, v: np.ndarray, near: np.ndarray, weight: np.ndarray, fixed: np.ndarray, others: np.ndarray, share: float, steps: int, exaggeration: float,
    rng: np.random.Generator, step: float = 1.0,
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and velocities of a block's rows after some steps.

    near: numbers of neighbours in the block, -1 for others; weight: affinities, 0 past the last; fixed: positions of all neighbours as they were;
    others: a sample of positions outside, which stand for a part 1 - share of all rows.
    """
    inside = near >= 0
    local, momentum, scale = np.where(inside, near, 0), 0.5 if exaggeration > 1 else 0.9, None
    mine = int(round(STEP_SAMPLE * share)) if len(others) else STEP_SAMPLE
    for _ in range(steps):
        apart = y[:, None] - np.where(inside[:, :, None], y[local], fixed)
        pull = (weight / (1 + (apart**2).sum(axis=2)))[:, :, None] * apart
        attract = np.where(inside[:, :, None], pull / 2, pull).sum(axis=1)
        for j in (0, 1):  # neighbours in the block are pulled back
            attract[:, j] -= np.bincount(local[inside], pull[:, :, j][inside] / 2, len(y))
        met = y[rng.integers(0, len(y), mine)]
        if len(others) and mine < STEP_SAMPLE:
            met = np.concatenate([met, others[rng.integers(0, len(others), STEP_SAMPLE - mine)]])
        kernel = (y[:, :1] - met[:, 0]) ** 2
        kernel += (y[:, 1:] - met[:, 1]) ** 2
        kernel += 1
        np.reciprocal(kernel, out=kernel)
        total = kernel.sum(axis=1).mean()
        scale = total if scale is None else 0.9 * scale + 0.1 * total
        kernel *= kernel
        away = y * kernel.sum(axis=1, keepdims=True) - kernel @ met
        v = momentum * v - step * (exaggeration * attract - away / scale)
        y = y + v
    return y, v


def layout(
    vectors: DataFrame, perplexity: float = 10.0, near: int = 30, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42, block_rows: int = BLOCK_ROWS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(id, x, y) of every row. The same for the same rows and seed, whatever the partitions."""
    kind, n = vectors.schema[id_col].dataType.simpleString(), vectors.count()
    model = neighbours.fit(vectors, 0.9, near, id_col, vector_col)
    mean, directions = principal(vectors, model.width, id_col, vector_col)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = neighbours.matrix(batch.column(1), model.width)
            y = (x - mean) @ directions.T * 0.05
            yield pa.record_batch([batch.column(0), pa.array(neighbours._closest(x, model.centres), pa.int32()), pa.array(y[:, 0]), pa.array(y[:, 1])], ["id", "list", "x", "y"])

    first = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(begin, f"id {kind}, list int, x double, y double")
    first = stored(first)
    sizes = first.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("parts"))  # one row for each list, of which a model has few
    blocks = sizes.agg(F.sum("parts")).first()[0] or 1
    first = first.join(F.broadcast(sizes), "list").withColumn("block", F.xxhash64("list", F.pmod(F.xxhash64("id"), F.col("parts"))))
    rows = stored(first.select("id", "block", "x", "y").join(graph(vectors, model, perplexity, near, id_col, vector_col), "id", "left"))
    steady = stored(_steady(rows, kind).repartition(max(1, min(blocks, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "block"))
    at = rows.select("block", F.lit(None).cast("long").alias("other"), "id", F.array("x", "y", F.lit(0.0), F.lit(0.0)).alias("p"), F.lit(None).cast("array<float>").alias("sent"))
    at = stored(_round(at, steady, kind, n, near, seed, 0, 1.0))
    for k in range(rounds):
        at = stored(_round(at, steady, kind, n, near, seed + k, STEPS, EXAGGERATION if k < EARLY else 1.0))
    return at.where("other IS NULL").select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def _steady(rows: DataFrame, kind: str) -> DataFrame:
    """(block, other, id, near, weight): what stays from round to round. Where other is null, a row with its neighbours as numbers among the block's rows
    and, after them, those it hears of, in order of the sending block and the id; else the numbers of a block's rows that another block waits for.
    """
    owners = rows.select(F.col("id").alias("to"), F.col("block").alias("owner"))
    asked = rows.select("block", F.explode("near").alias("to")).groupBy("to").agg(F.collect_set("block").alias("blocks"))
    asked = asked.join(owners, "to").select("owner", "to", F.explode("blocks").alias("block")).where("owner <> block")
    asked = stored(asked.groupBy("owner", "block").agg(F.array_sort(F.collect_list("to")).alias("ids")))
    heard = asked.select("block", F.col("owner").alias("other"), "ids", F.lit(False).alias("sends"))
    both = heard.unionByName(asked.select(F.col("owner").alias("block"), F.col("block").alias("other"), "ids", F.lit(True).alias("sends")))

    def run(rows: pa.Table, lists: pa.Table) -> pa.Table:
        rows, lists = rows.sort_by("id"), lists.sort_by("other")
        ids = rows.column("id").combine_chunks()
        heard, sends = lists.filter(pc.invert(lists.column("sends"))), lists.filter(lists.column("sends"))
        known = pa.concat_arrays([ids, heard.column("ids").combine_chunks().flatten()])
        near, send = rows.column("near").combine_chunks(), sends.column("ids").combine_chunks()
        numbers = lambda x, of: pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.asarray(x.value_lengths().fill_null(0)))]), pa.int32()), pc.index_in(x.flatten(), value_set=of)
        )
        some = pa.table([rows.column("block"), pa.nulls(len(ids), pa.int64()), ids, numbers(near, known), rows.column("weight")], names=["block", "other", "id", "near", "weight"])
        return pa.concat_tables(
            [some, pa.table([sends.column("block"), sends.column("other"), pa.nulls(len(sends), ids.type), numbers(send, ids), pa.nulls(len(sends), some.schema.field("weight").type)], schema=some.schema)]
        )

    met = rows.select("block", "id", "near", "weight").groupBy("block").cogroup(both.groupBy("block"))
    return met.applyInArrow(run, f"block bigint, other bigint, id {kind}, near array<int>, weight array<float>")


def _round(at: DataFrame, steady: DataFrame, kind: str, n: int, near: int, seed: int, steps: int, exaggeration: float) -> DataFrame:
    """(block, other, id, p, sent) after some steps. Where other is null, a row's position and velocity; else the positions that this other block sends."""
    sample = at.where("other IS NULL").select("block", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), "id")
    sample = sample.orderBy(F.xxhash64(F.lit(seed), "id")).limit(SAMPLE).drop("id").toPandas()
    places, blocks = sample[["x", "y"]].to_numpy(), sample["block"].to_numpy()

    def run(steady: pa.Table, at: pa.Table) -> pa.Table:
        lines, sends = steady.filter(pc.is_null(steady.column("other"))).sort_by("id"), steady.filter(pc.is_valid(steady.column("other")))
        rows, heard = at.filter(pc.is_null(at.column("other"))).sort_by("id"), at.filter(pc.is_valid(at.column("other"))).sort_by("other")
        ids, number = rows.column("id").combine_chunks(), rows.column("block")[0].as_py()
        state = np.asarray(rows.column("p").combine_chunks().flatten()).reshape(-1, 4)
        y, v = state[:, :2], state[:, 2:]
        if steps:
            lists = lines.column("near").combine_chunks()
            counts = np.asarray(lists.value_lengths().fill_null(0))
            row = np.repeat(np.arange(len(ids)), counts)
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            numbers = np.asarray(lists.flatten())
            to, weight, fixed = np.full((len(ids), near), -1), np.zeros((len(ids), near)), np.zeros((len(ids), near, 2))
            to[row, place] = np.where(numbers < len(ids), numbers, -1)
            weight[row, place] = np.asarray(lines.column("weight").combine_chunks().flatten())
            fixed[row, place] = np.concatenate([y, np.asarray(heard.column("sent").combine_chunks().flatten(), float).reshape(-1, 2)])[numbers]
            rng = np.random.default_rng([seed, number & ((1 << 63) - 1)])
            y, v = descend(y, v, to, weight, fixed, places[blocks != number], len(ids) / n, steps, exaggeration, rng)
        moved = pa.array(np.concatenate([y, v], axis=1).ravel())
        moved = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * 4, pa.int32()), moved)
        named = ["block", "other", "id", "p", "sent"]
        state = pa.table([rows.column("block"), pa.nulls(len(ids), pa.int64()), ids, moved, pa.nulls(len(ids), pa.list_(pa.float32()))], names=named)
        lists = sends.column("near").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]) * 2
        sent = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(y[np.asarray(lists.flatten())].ravel(), pa.float32()))
        return pa.concat_tables([state, pa.table([sends.column("other"), sends.column("block"), pa.nulls(len(sends), ids.type), pa.nulls(len(sends), moved.type), sent], names=named)])

    met = steady.groupBy("block").cogroup(at.groupBy("block"))
    return met.applyInArrow(run, f"block bigint, other bigint, id {kind}, p array<double>, sent array<float>")
