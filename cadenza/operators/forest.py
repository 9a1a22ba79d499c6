"""Random forests over a table of bounded size: each task has all its rows and grows some of the trees, whole.

A tree of depth 30 has about as many nodes as rows, and most of them hold a few rows. Grown by Spark, each node has a table of its own for each
feature, bin and class, in each part of the rows; grown here, a level costs sorts of the rows that are left. Splits are exact: between any two
neighbouring values of a feature, by Gini impurity, among as many random features of each node as the root of their number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks for each core, and the unit of votes, whole numbers so that their sum does not depend on its order.
TASKS_PER_CORE, UNIT = 2, 1 << 32
#: Rows, once for each feature, whose cuts are judged at once.
SIDE_ROWS = 1 << 16


class Tree(NamedTuple):
    """By node: its feature (-1: a leaf), the largest value that goes left, the left child, next to which is the right one, and shares of classes."""

    feature: np.ndarray
    most: np.ndarray
    child: np.ndarray
    shares: np.ndarray


def ranks(x: np.ndarray) -> np.ndarray:
    """The dense rank of each value in its column."""
    return np.stack([np.unique(c, return_inverse=True)[1].reshape(-1) for c in x.T], axis=1).astype(np.int64)


def _running(values: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running sums that start anew with each group."""
    total = np.cumsum(values)
    return total - (total[starts] - values[starts])[group]


def _scores(y: np.ndarray, w: np.ndarray, group: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For rows sorted by group and value, and class weights by group: the sums of squared class weights over weights, left and right of a cut after each
    row. The larger, the purer.
    """
    bits = len(y).bit_length()
    key = np.sort(((group * counts.shape[1] + y) << bits) | np.arange(len(y)))
    at, kind = key & ((1 << bits) - 1), key >> bits
    first = np.concatenate([[True], kind[1:] != kind[:-1]])
    before = np.empty_like(w)  # the weight of the row's class before it in its group
    before[at] = _running(w[at], np.flatnonzero(first), np.cumsum(first) - 1) - w[at]
    left = _running(w, starts, group)
    squares = _running(w * (2 * before + w), starts, group)
    both = _running(w * counts[group, y], starts, group)
    with np.errstate(divide="ignore", invalid="ignore"):
        return squares / left + ((counts**2).sum(axis=1)[group] - 2 * both + squares) / (counts.sum(axis=1)[group] - left)


def grow(x: np.ndarray, rank: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, depth: int, rng: np.random.Generator) -> Tree:
    """A tree on rows by their weights, whole numbers that are not all 0, level by level. A node stays whole where no cut makes it purer."""
    rows = np.flatnonzero(weight)
    node, some = np.zeros(len(rows), np.int64), math.ceil(math.sqrt(x.shape[1]))
    value_bits, levels, made, n = int(rank.max()).bit_length() + 1, [], 1, 1
    for level in range(depth + 1):
        w, label = weight[rows], y[rows]
        counts = np.bincount(node * classes + label, w, n * classes).reshape(n, classes).astype(np.int64)
        total = counts.sum(axis=1)
        feature, most, child = np.full(n, -1), np.zeros(n), np.full(n, -1)
        levels.append((feature, most, child, counts / total[:, None]))
        is_open = (counts.max(axis=1) < total) & (level < depth)
        if not is_open.any():
            break
        held = is_open[node]
        places = np.flatnonzero(is_open)
        rows, w, label, node, counts, total = rows[held], w[held], label[held], (np.cumsum(is_open) - 1)[node[held]], counts[places], total[places]
        bits, chosen = len(rows).bit_length(), rng.random((len(places), x.shape[1])).argpartition(some - 1, axis=1)[:, :some]
        top = (counts**2).sum(axis=1) / total * (1 + 1e-12)
        split, cut = np.full(len(places), -1), np.zeros(len(places))
        side = max(1, min(some, SIDE_ROWS // len(rows)))
        for k in range(0, some, side):
            features = chosen[:, k : k + side]
            width = features.shape[1]
            group = (node[:, None] * width + np.arange(width)).reshape(-1)  # of node and feature
            place = np.repeat(np.arange(len(rows)), width)
            key = np.sort((((group << value_bits) | rank[rows[place], features.reshape(-1)[group]]) << bits) | place)
            at, value = key & ((1 << bits) - 1), key >> bits  # of group and value
            group = value >> value_bits
            ends = group[1:] != group[:-1]
            starts = np.flatnonzero(np.concatenate([[True], ends]))
            score = _scores(label[at], w[at], group, starts, np.repeat(counts, width, axis=0))
            score[np.concatenate([ends | (value[1:] == value[:-1]), [True]])] = -np.inf
            best = np.maximum.reduceat(score, starts).reshape(-1, width)
            which = best.argmax(axis=1)
            best = best[np.arange(len(best)), which]
            wanted = np.full(len(starts), np.inf)
            wanted[(np.arange(len(best)) * width + which)[best > top]] = best[best > top]
            hits = np.flatnonzero(score == wanted[group])
            to = group[hits]
            hits = hits[np.concatenate([[True], to[1:] != to[:-1]])] if len(hits) else hits  # the first of equal cuts
            to, feature_of = group[hits] // width, features.reshape(-1)[group[hits]]
            low, high = x[rows[at[hits]], feature_of], x[rows[at[hits + 1]], feature_of]
            with np.errstate(invalid="ignore"):
                middle = low / 2 + high / 2
            top[to], split[to], cut[to] = score[hits], feature_of, np.where((middle >= low) & (middle < high), middle, low)
        done = split >= 0
        feature[places], most[places] = split, cut
        child[places[done]] = made + 2 * np.arange(done.sum())
        made, n = made + 2 * int(done.sum()), 2 * int(done.sum())
        if not n:
            break
        held = done[node]
        rows, node = rows[held], node[held]
        node = 2 * (np.cumsum(done) - 1)[node] + (x[rows, split[node]] > cut[node])
        order = np.argsort(node, kind="stable")
        rows, node = rows[order], node[order]
    return Tree(*(np.concatenate(c) for c in zip(*levels)))


def shares(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The shares of classes in the leaf of each row."""
    at = np.zeros(len(x), np.int64)
    moves = np.arange(len(x))
    while len(moves := moves[tree.feature[at[moves]] >= 0]):
        here = at[moves]
        at[moves] = tree.child[here] + (x[moves, tree.feature[here]] > tree.most[here])
    return tree.shares[at]


def votes(rows: DataFrame, classes: int, folds: int, trees: int, depth: int, seed: int) -> DataFrame:
    """(row, y, votes) for rows (id, fold, y, x): by class, the summed shares of the trees that were grown without the row's fold, in whole numbers.
    Rows are numbered by id, and each tree has its own generator, so neither the table's parts nor the number of tasks matters.

    Every task is sent all rows, whose number the caller bounds.
    """
    tasks = TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        ids, fold, y = (table.column(c).to_numpy() for c in ("id", "fold", "y"))
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.lexsort((*x.T, y, ids))
        fold, y, x, task = fold[order], y[order].astype(np.int64), x[order], table.column("task")[0].as_py()
        del table
        rank, found = ranks(x), np.zeros((len(x), classes), np.int64)
        for k in range(folds):
            others, mine = fold != k, np.flatnonzero(fold == k)
            for tree in range(trees):
                if (k * trees + tree) % tasks == task and len(mine):
                    rng = np.random.default_rng([seed, k, tree])
                    weight = rng.poisson(1.0, len(x)) * others
                    if weight.any():
                        grown = grow(x, rank, y, weight, classes, depth, rng)
                        found[mine] += np.rint(shares(grown, x[mine]) * UNIT).astype(np.int64)
        for at in range(0, len(x), 8192):
            part = found[at : at + 8192]
            offsets = pa.array(np.arange(0, part.size + 1, classes, dtype=np.int32))
            yield pa.record_batch(
                [pa.array(np.arange(at, at + len(part))), pa.array(y[at : at + 8192]), pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1)))],
                ["row", "y", "votes"]
            )

    numbers = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))
    sent = rows.withColumn("task", numbers).repartitionById(tasks, "task").mapInArrow(run, "row bigint, y bigint, votes array<bigint>")
    return sent.groupBy("row", "y").agg(F.array(*[F.sum(F.col("votes")[c]) for c in range(classes)]).alias("votes"))
