"""Search by dynamic time warping that prunes: lower bounds first, then distances that are given up early.

Two series are as similar as 1 - distance / (their lengths together), at least 0. A search keeps the ``top`` best of each query; another series
matters only if its distance is at most what the worst of those allows. Before any warping, three bounds are compared with that:

- warping matches each value of a series with some value of the other, so the distances of all values to the other's nearest value are a lower
  bound, either way round; values outside the other's envelope count in full;
- first values are matched with each other, and last ones, so what is between them counts at least;
- no distance can make a similarity below 0, so a bound that reaches the lengths settles the similarity without a distance.

What is left is warped row by row, many series at once against one query, in memory of one row each; a series is given up as soon as no value
of its row is within what it may cost. None of it changes the result: the same rows come back as from all full distances.

Rows and queries meet in blocks of bounded size, dealt by a hash, in one task each; each task keeps the best of its part for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Series of a part, queries of a block, and series that are warped at once, at first and at most.
PART_SERIES, BLOCK_QUERIES, BATCH, MOST_BATCH = 4096, 8192, 128, 4096
#: Tasks for each core where parts and blocks are few: they are dealt by a hash, unevenly, and each takes long.
TASKS_PER_CORE = 8
#: Cells of the batch's rows at most: long series are warped in smaller batches.
BATCH_CELLS = 1 << 22
#: Distinct values of a part up to which its bounds are computed for all pairs at once.
BOUND_VALUES = 1024
#: Slack of the bounds for sums in another order.
_SLACK = 1e-9


def packed(series: list[np.ndarray]) -> np.ndarray:
    """Series that are not empty as columns, each continued with its last value; whole numbers as integers."""
    lengths = np.array([len(x) for x in series])
    flat = np.concatenate(series)
    at = np.minimum(np.arange(lengths.max())[:, None], lengths - 1) + np.cumsum(lengths) - lengths
    most = np.abs(flat).max()
    whole = most < 1 << 20 and (flat == np.rint(flat)).all()
    return flat.astype((np.int16 if most < 1 << 14 else np.int32) if whole else np.float64)[at]


def _kind(query: np.ndarray, columns: np.ndarray) -> type:
    """The smallest type that holds all distances of a query and columns exactly, as far as they are whole numbers."""
    if columns.dtype.kind != "i" or not (query == np.rint(query)).all():
        return np.float64
    most = (float(np.abs(query).max()) + float(np.abs(columns).max())) * (len(query) + len(columns))
    return np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64


def warped(query: np.ndarray, columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Warping distances of a series to the columns of packed(). A row of the matrix is computed cell by cell, each cell for all columns at once."""
    values = columns.astype(kind := _kind(query, columns))
    query = query.astype(kind)
    row = np.cumsum(np.abs(values - query[0]), axis=0, dtype=kind)
    cost, entered, least = np.empty_like(values), np.empty_like(values), np.empty_like(values[0])
    lines = list(zip(entered[1:], row[:-1], cost[1:], row[1:]))
    for q in query[1:]:
        np.subtract(values, q, out=cost)
        np.abs(cost, out=cost)
        np.minimum(row[1:], row[:-1], out=entered[1:])
        np.add(row[0], cost[0], out=row[0])
        for above, left, c, cell in lines:
            np.minimum(above, left, out=least)
            np.add(least, c, out=cell)
    return row[lengths - 1, np.arange(len(lengths))].astype(float)


def within(query: np.ndarray, columns: np.ndarray, lengths: np.ndarray, most: np.ndarray) -> np.ndarray:
    """What warped() gives where it is at most ``most``, else infinite. Cells that exceed it in all columns are left out at either end of a row, and
    columns of which all cells do are given up. A cell past the end of a series is never below its last one.
    """
    n, alive, out = len(columns), np.arange(columns.shape[1]), np.full(columns.shape[1], np.inf)
    kind = np.float64
    if columns.dtype.kind == "i" and (query == np.rint(query)).all():
        largest = float(np.abs(query).max()) + float(np.abs(columns).max()) + float(most.max()) + 4
        kind = np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.float64
    limit = (most + _SLACK if kind == np.float64 else np.floor(most + _SLACK)).astype(kind)
    over, values, query = kind(limit.max() + 1), columns.astype(kind, copy=False), query.astype(kind)
    row = np.full((n + 1, len(alive)), over)  # the first line stays over
    row[1] = np.minimum(np.abs(values[0] - query[0]), over)
    low = last = 1
    for k, q in enumerate(query):
        if k:
            last = min(n, high + 8)
            entered, cost = np.minimum(row[low : last + 1], row[low - 1 : last]), np.abs(values[low - 1 : last] - q)
            left = row[low - 1]
            for above, c, cell in zip(entered, cost, row[low : last + 1]):
                np.minimum(above, left, out=above)
                np.add(above, c, out=cell)
                left = cell
        while last < n and (row[last] <= limit).any():
            last += 1
            np.minimum(row[last - 1] + np.abs(values[last - 1] - q), over, out=row[last])
        np.minimum(row[low : last + 1], over, out=row[low : last + 1])
        lives = np.flatnonzero((row[low : last + 1] <= limit).any(axis=1))
        if not len(lives):
            return out
        high, begin = low + int(lives[-1]), low + int(lives[0])
        row[high + 1 : last + 1], row[low:begin] = over, over
        low = begin
        if k % 3 == 2:
            goes_on = (row[low : high + 1] <= limit).any(axis=0)
            if goes_on.mean() < 0.8:
                alive, limit, values, row = alive[goes_on], limit[goes_on], values[:, goes_on], row[:, goes_on]
    found = row[lengths[alive], np.arange(len(alive))]
    out[alive] = np.where(found <= limit, found, np.inf)
    return out


def distances(query: np.ndarray, others: list[np.ndarray], most: np.ndarray | None = None) -> np.ndarray:
    """Warping distances of one series to others, none of them empty; infinite for those that exceed ``most``, which are given up early."""
    others = [np.asarray(x, float) for x in others]
    columns, lengths = packed(others), np.array([len(x) for x in others])
    return warped(np.asarray(query, float), columns, lengths) if most is None else within(np.asarray(query, float), columns, lengths, most)


def batches(lengths: np.ndarray, size: int = MOST_BATCH, cells: int = BATCH_CELLS) -> list[np.ndarray]:
    """Places of series that are not empty, by length, in batches of bounded size."""
    order = np.argsort(lengths, kind="stable")
    order, out = order[lengths[order] > 0], []
    while len(order):
        fit = lengths[order[:size]] * np.arange(1, len(order[:size]) + 1) <= cells
        out.append(order[: max(1, int(fit.argmin()) if not fit.all() else len(fit))])
        order = order[len(out[-1]) :]
    return out


def _to_nearest(values: np.ndarray, counts: np.ndarray, support: np.ndarray) -> float:
    """The distances of values, each so many times, to the nearest of a sorted support."""
    at = np.searchsorted(support, values)
    above, below = support[np.minimum(at, len(support) - 1)], support[np.maximum(at - 1, 0)]
    return float((np.minimum(np.abs(values - above), np.abs(values - below)) * counts).sum())


class Series:
    """A series and what its bounds need."""

    def __init__(self, values: np.ndarray):
        self.values = np.asarray(values, float)
        self.support, self.counts = np.unique(self.values, return_counts=True)

    def bound(self, other: Series) -> float:
        """No more than the warping distance."""
        one, two = _to_nearest(self.support, self.counts, other.support), _to_nearest(other.support, other.counts, self.support)
        a, b = self.values, other.values
        ends = abs(a[0] - b[0]) + (abs(a[-1] - b[-1]) if max(len(a), len(b)) > 1 else 0.0)
        return max(one, two, ends)


def bounds(queries: list[Series], others: list[Series]) -> np.ndarray:
    """Series.bound of each query (rows) with each other series (columns); infinite where one is empty, 0 where both are."""
    out = np.full((len(queries), len(others)), np.inf)
    mine, theirs = ([k for k, x in enumerate(s) if len(x.values)] for s in (queries, others))
    out[np.ix_([k for k, x in enumerate(queries) if not len(x.values)], [k for k, x in enumerate(others) if not len(x.values)])] = 0
    if not mine or not theirs:
        return out
    a, b = [queries[k] for k in mine], [others[k] for k in theirs]
    support = np.unique(np.concatenate([x.support for x in a + b]))
    if len(support) > BOUND_VALUES:
        out[np.ix_(mine, theirs)] = [[x.bound(y) for y in b] for x in a]
        return out

    def tables(series: list[Series]) -> tuple[np.ndarray, np.ndarray]:
        counts, near = np.zeros((len(series), len(support))), np.empty((len(series), len(support)))
        for k, x in enumerate(series):
            counts[k, np.searchsorted(support, x.support)] = x.counts
            at = np.searchsorted(x.support, support)
            near[k] = np.minimum(np.abs(support - x.support[np.minimum(at, len(x.support) - 1)]), np.abs(support - x.support[np.maximum(at - 1, 0)]))
        return counts, near

    (a_counts, a_near), (b_counts, b_near) = tables(a), tables(b)
    ends = lambda k: np.abs(np.subtract.outer([x.values[k] for x in a], [x.values[k] for x in b]))
    longer = np.maximum.outer([len(x.values) for x in a], [len(x.values) for x in b]) > 1
    out[np.ix_(mine, theirs)] = np.maximum(np.maximum(a_counts @ b_near.T, a_near @ b_counts.T), ends(0) + np.where(longer, ends(-1), 0.0))
    return out


class Part:
    """The series of a part, those that are not empty as columns unless they are too many cells."""

    def __init__(self, others: list[Series]):
        self.others = others
        self.lengths = np.array([len(x.values) for x in others], int)
        self.filled = np.flatnonzero(self.lengths)
        small = len(self.filled) and self.lengths.max() * len(self.filled) <= BATCH_CELLS
        self.columns = packed([others[k].values for k in self.filled]) if small else None
        self.place = np.cumsum(self.lengths > 0) - 1

    def distances(self, query: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        if self.columns is None:
            return distances(query, [self.others[k].values for k in at], most)
        return within(query, self.columns[: self.lengths[at].max(), self.place[at]], self.lengths[at], most)


def best(query: Series, others: Part, ids: np.ndarray, keep: np.ndarray, bounds: np.ndarray, top: int) -> tuple[list[tuple[int, float]], np.ndarray]:
    """The ``top`` most similar of the series to keep as (place, similarity), ties by id; and how many were compared, settled by a bound, given up, and
    warped.
    """
    total = np.maximum(len(query.values) + others.lengths, 1).astype(float)
    ceiling = np.round(np.maximum(0.0, 1 - (bounds - _SLACK) / total), 9)  # no similarity is above it
    order = keep[np.lexsort((ids[keep], -ceiling[keep]))]
    found: list[tuple[float, object, int]] = []  # (-similarity, id, place), the best first
    counts = np.array([len(keep), 0, 0, 0])
    at, batch = 0, BATCH
    while at < len(order):
        size = max(1, min(batch, BATCH_CELLS // max(1, others.lengths[order[at : at + batch]].max())))
        part, at, batch = order[at : at + size], at + size, min(2 * batch, MOST_BATCH)
        worst = found[top - 1][:2] if len(found) >= top else (np.inf, None)
        # below the worst so far, or equal to it with a later id
        beaten = np.zeros(len(part), bool)
        if worst[1] is not None:
            beaten = (-ceiling[part] > worst[0]) | ((-ceiling[part] == worst[0]) & (ids[part] > worst[1]))
        settled = (ceiling[part] <= 0) | ~np.isfinite(bounds[part])
        counts[1] += (beaten | settled).sum()
        found += sorted((0.0, ids[k], int(k)) for k in part[settled & ~beaten])[:top]
        open_ = part[~beaten & ~settled]
        if len(open_):
            # the most that a distance may be for a similarity that still matters; below 0 none does
            least = -worst[0] if worst[1] is not None else 0.0
            most = np.minimum((1 - least + 1e-9) * total[open_], total[open_])
            d = others.distances(query.values, open_, most) if len(query.values) else np.zeros(len(open_))
            given_up = np.isinf(d)
            counts[2] += given_up.sum()
            counts[3] += (~given_up).sum()
            scores = np.where(given_up, 0.0, np.round(np.maximum(0.0, 1 - d / total[open_]), 9))
            # one that was given up against a worst above 0 is out; against 0 its similarity is 0
            stays = np.flatnonzero(~given_up | (least <= 0))
            stays = stays[np.lexsort((ids[open_[stays]], -scores[stays]))[:top]]
            found += [(-float(scores[k]), ids[open_[k]], int(open_[k])) for k in stays]
        found.sort(key=lambda x: x[:2])
        del found[top:]
        # no bound from here on can be better than what is found: all that is left counts as settled by its bound
        if len(found) >= top and at < len(order) and (-ceiling[order[at]], -np.inf) > (found[-1][0], np.inf):
            counts[1] += len(order) - at
            break
    return [(k, -s) for s, _, k in found], counts


def series_of(notes: DataFrame, feature: str = "interval", least_notes: int = 10) -> DataFrame:
    """(piece_id, x) of pieces of at least so many notes: their pitches or intervals in order."""
    pitches = F.transform(F.array_sort(F.collect_list(F.struct("seq", "pitch"))), lambda x: x["pitch"].cast("double"))
    pieces = notes.groupBy("piece_id").agg(pitches.alias("x")).where(F.size("x") >= least_notes)
    if feature == "pitch":
        return pieces
    steps = F.transform(F.sequence(F.lit(1), F.size("x") - 1), lambda i: F.get("x", i) - F.get("x", i - 1))
    return pieces.withColumn("x", F.when(F.size("x") > 1, steps).otherwise(F.array().cast("array<double>")))


def parts_and_blocks(rows: DataFrame, queries: DataFrame, part_rows: int, block_queries: int, tasks_per_core: int = 2) -> tuple[int, int]:
    """Into how many parts and blocks of at most these sizes on average rows and queries are dealt; blocks are smaller where there would be too few
    tasks for the cores.
    """
    parts, asked = max(1, -(-rows.count() // part_rows)), queries.count()
    tasks = tasks_per_core * rows.sparkSession.sparkContext.defaultParallelism
    return parts, max(1, -(-asked // block_queries), min(asked, -(-tasks // parts)))


def similar(
    series: DataFrame, queries: DataFrame, top: int = 10, part_series: int = PART_SERIES, block_queries: int = BLOCK_QUERIES
) -> tuple[DataFrame, DataFrame]:
    """Two tables for series and queries (piece_id, x): (query, piece_id, rank, similarity), the ``top`` most similar other series of each query, ties
    by piece; and (query, pairs, by_bound, given_up, warped), what became of each query's pairs.

    A null series takes no part. Empty series have similarity 1 with each other and 0 with others.
    """
    kind = series.schema["piece_id"].dataType.simpleString()
    series, queries = (d.where(F.col("x").isNotNull() & F.col("piece_id").isNotNull()) for d in (series, queries))
    parts, blocks = parts_and_blocks(series, queries, part_series, block_queries, TASKS_PER_CORE)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = series.withColumn("part", F.pmod(F.xxhash64("piece_id"), F.lit(parts)).cast("int")).withColumn("block", numbers(blocks))
    asked = queries.select(F.col("piece_id").alias("query"), F.col("x").alias("qx"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("part", numbers(parts))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        others = [Series(np.array(x, float)) for x in rows.column("x").to_pylist()]
        ids, out, part = np.array(rows.column("piece_id").to_pylist()), [], Part(others)
        names, lists = asked.column("query").to_pylist(), asked.column("qx")
        for first in range(0, len(names), 64):
            some = [Series(np.array(x, float)) for x in lists.slice(first, 64).to_pylist()]
            for name, query, bound in zip(names[first : first + 64], some, bounds(some, others)):
                keep = np.flatnonzero(ids != name)
                if len(keep):
                    found, counts = best(query, part, ids, keep, bound, top)
                    out += [(name, ids[k].item(), s, *(counts.tolist() if n == 0 else [0] * 4)) for n, (k, s) in enumerate(found)]
        columns = list(zip(*out)) if out else [[]] * 7
        types = [rows.schema.field("piece_id").type] * 2 + [pa.float64()] + [pa.int64()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["query", "piece_id", "similarity", "pairs", "by_bound", "given_up", "warped"])

    schema = f"query {kind}, piece_id {kind}, similarity double, pairs bigint, by_bound bigint, given_up bigint, warped bigint"
    met = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(run, schema)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "piece_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query", "piece_id", "rank", "similarity")
    return ranked, met.groupBy("query").agg(*[F.sum(c).alias(c) for c in ("pairs", "by_bound", "given_up", "warped")])
