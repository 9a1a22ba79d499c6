"""Similarity of pieces and vectors: cosine, Pearson, alignment, longest common subsequence, hashing.

Searches take a stated set of queries against all rows. Parts of the rows and blocks of the queries, both of bounded size, meet by a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import by_seq
from . import neighbours, warping

#: Bands and sign bits of a band in the index of vectors, which reach the nearest ten even where no vectors lie close to each other.
BANDS, BAND_BITS = 64, 6
#: Pieces of a part, queries of a block where all pairs are returned and where only the best are, and queries that are judged at a time.
PART_PIECES, BLOCK_QUERIES, SEARCH_QUERIES, SLICE = 4096, 512, 8192, 256
#: Places whose values are held as a matrix at a time, for the pieces of a part.
PLACES = 512

#: What a measure makes of the series of a part and of some queries: arrays (query, piece), and which pairs it judges at all, if not all.
Judged = tuple[list[np.ndarray], np.ndarray | None]


def _best_of(scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, piece) of the ``top`` highest scores of each query, of equal ones the first; scores of minus infinity are none."""
    least = -np.partition(-scores, top - 1, axis=1)[:, top - 1] if scores.shape[1] > top else np.full(len(scores), -np.inf)
    rows, columns = [], []
    for k, (line, last) in enumerate(zip(scores, least)):
        better, equal = np.flatnonzero(line > last), np.flatnonzero(line == last) if last > -np.inf else np.zeros(0, int)
        columns.append(np.concatenate([better, equal[: max(0, top - len(better))]]))
        rows.append(np.full(len(columns[-1]), k))
    return np.concatenate(rows), np.concatenate(columns)


def _pairs(
    pieces: DataFrame, queries: DataFrame, judge: Callable[[pa.Array], Callable[[pa.Array], Judged]], columns: str, top: int | None = None, part_pieces: int = PART_PIECES,
    block_queries: int | None = None,
) -> DataFrame:
    """(query, piece_id, and what ``judge`` makes of the series of the piece and of the query) for every query with every other piece that it judges, both tables
    being (piece_id, x). With ``top``, only the pairs with the highest first measure (to nine digits) of each query in each part, ties by piece.

    Parts of the pieces and blocks of the queries meet by a shuffle, so nothing is broadcast; a task judges slices of its queries with all pieces of its
    part at once. Without ``top`` the result has a row for each pair, by definition.
    """
    pieces, queries = (d.where(F.col("piece_id").isNotNull()) for d in (pieces, queries))
    parts, blocks = warping.parts_and_blocks(pieces, queries, part_pieces, block_queries or (SEARCH_QUERIES if top else BLOCK_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("piece_id"), F.lit(parts)).cast("int")).withColumn("block", each(blocks))
    asked = queries.select(F.col("piece_id").alias("query"), F.col("x").alias("q"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    kind = pieces.schema["piece_id"].dataType.simpleString()
    names = [c.split()[0] for c in columns.split(", ")]
    types = [pa.int32() if c.split()[1] == "int" else pa.float64() for c in columns.split(", ")]

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.sort_by("piece_id")
        ids, searched = rows.column("piece_id").combine_chunks(), asked.column("query").combine_chunks()
        out, schema = [], pa.schema([("query", ids.type), ("piece_id", ids.type), *zip(names, types)])
        of = judge(rows.column("x").combine_chunks()) if len(ids) else None
        for at in range(0, len(searched) if len(ids) else 0, SLICE):
            some = searched.slice(at, SLICE)
            values, met = of(asked.column("q").slice(at, SLICE).combine_chunks())
            met = np.not_equal.outer(np.asarray(some), np.asarray(ids)) & (True if met is None else met)
            q, p = _best_of(np.where(met, np.round(values[0], 9), -np.inf), top) if top else np.nonzero(met)
            out.append(pa.table([some.take(pa.array(q)), ids.take(pa.array(p)), *(pa.array(v[q, p]).cast(t) for v, t in zip(values, types))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(run, f"query {kind}, piece_id {kind}, {columns}")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(dot(a, b) / F.when(norms > 0, norms), F.lit(0.0))


def nearest(
    vectors: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = neighbours.PART_ROWS
) -> DataFrame:
    """(query, neighbour, score, rank): exact cosine neighbours of each query among all other rows, in blocks of rows and queries."""
    return neighbours.exact(vectors, queries, top, id_col, vector_col, part_rows)


def _placed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of lists of (at, value), or of values whose places are their order; a value that is null is not a number."""
    row, flat = np.repeat(np.arange(len(column)), np.asarray(column.value_lengths().fill_null(0))), column.flatten()
    if pa.types.is_struct(flat.type):
        return row, np.asarray(flat.field("at")), np.asarray(flat.field("value").cast(pa.float64()), float)
    return row, np.arange(len(row)) - np.searchsorted(row, row), np.asarray(flat.cast(pa.float64()), float)


def _exact_pearson(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of two arrays of equal length; 0 without variation."""
    if not len(a) or not np.ptp(a) or not np.ptp(b):
        return 0.0
    a, b = a - a.mean(), b - b.mean()
    return float((a * b).sum()) / float(np.sqrt((a**2).sum() * (b**2).sum()))


def _pearson(pieces: pa.Array, apart: bool = True) -> Callable[[pa.Array], Judged]:
    """Correlation over the places that both have, and the same as a similarity; pairs without such a place are not judged if ``apart``, else not correlated.

    Both come from sums over blocks of places, which are products of matrices; whole numbers lose nothing. Of other numbers, pairs that hardly vary
    are computed one by one.
    """
    row, place, value = _placed(pieces)
    order = np.argsort(place, kind="stable")
    row, place, value = row[order], place[order], value[order]

    def judge(queries: pa.Array) -> Judged:
        q_row, q_place, q_value = _placed(queries)
        order = np.argsort(q_place, kind="stable")
        q_row, q_place, q_value = q_row[order], q_place[order], q_value[order]
        shared = np.intersect1d(place, q_place)
        known = np.concatenate([value[~np.isnan(value)], q_value[~np.isnan(q_value)]])
        middle, whole = float(np.rint(known.mean())) if len(known) else 0.0, bool((known == np.rint(known)).all())
        shape = (len(queries), len(pieces))
        met, n, sx, sy, sxx, syy, sxy = (np.zeros(shape) for _ in range(7))

        def block(rows: np.ndarray, places: np.ndarray, values: np.ndarray, wanted: np.ndarray, count: int) -> list[np.ndarray]:
            a, b = np.searchsorted(places, wanted[0]), np.searchsorted(places, wanted[-1], "right")
            at = np.searchsorted(wanted, places[a:b])
            fits = wanted[at] == places[a:b]
            has, x = np.zeros((count, len(wanted))), np.full((count, len(wanted)), np.nan)
            has[rows[a:b][fits], at[fits]], x[rows[a:b][fits], at[fits]] = 1.0, values[a:b][fits] - middle
            valid = 1.0 - np.isnan(x)
            return [has, valid, np.nan_to_num(x)]

        for at in range(0, len(shared), PLACES):
            wanted = shared[at : at + PLACES]
            (p_has, p_valid, x), (q_has, q_valid, y) = block(row, place, value, wanted, shape[1]), block(q_row, q_place, q_value, wanted, shape[0])
            met += q_has @ p_has.T
            n += q_valid @ p_valid.T
            sx, sxx = sx + q_valid @ x.T, sxx + q_valid @ (x * x).T
            sy, syy, sxy = sy + y @ p_valid.T, syy + (y * y) @ p_valid.T, sxy + y @ x.T
        a, b = n * sxx - sx * sx, n * syy - sy * sy
        varies = (a > 0) & (b > 0) & (n > 1)
        r = np.where(varies, (n * sxy - sx * sy) / np.sqrt(np.where(varies, a, 1.0)) / np.sqrt(np.where(varies, b, 1.0)), 0.0)
        if not whole:
            by_piece, by_query = (np.argsort(k, kind="stable") for k in (row, q_row))
            p_ends, q_ends = np.searchsorted(row[by_piece], np.arange(shape[1] + 1)), np.searchsorted(q_row[by_query], np.arange(shape[0] + 1))
            for i, j in zip(*np.nonzero((n > 1) & ((a <= 1e-6 * n * sxx) | (b <= 1e-6 * n * syy)))):
                mine, theirs = by_query[q_ends[i] : q_ends[i + 1]], by_piece[p_ends[j] : p_ends[j + 1]]
                mine, theirs = mine[~np.isnan(q_value[mine])], theirs[~np.isnan(value[theirs])]
                _, k, m = np.intersect1d(q_place[mine], place[theirs], return_indices=True)
                r[i, j] = _exact_pearson(q_value[mine][k], value[theirs][m])
        r = np.clip(r, -1.0, 1.0)
        return [r, (r + 1) / 2], met > 0 if apart else None

    return judge


def pearson_to(notes: DataFrame, queries: DataFrame, column: str = "pitch", top: int | None = None, **sizes: int) -> DataFrame:
    """(query, piece_id, r, similarity) of every other piece with each piece in ``queries``, where they have a place in common; over the places that
    both have; (r + 1) / 2, and r = 0 without variation. With ``top``, at least the so many most similar of each query; best_tracks() ranks them.
    """

    def series(n: DataFrame) -> DataFrame:
        return n.groupBy("piece_id").agg(F.collect_list(F.struct(F.col("seq").alias("at"), F.col(column).cast("double").alias("value"))).alias("x"))

    if top:
        return _pairs(series(notes), series(queries), _similar_first, "similarity double, r double", top, **sizes)
    return _pairs(series(notes), series(queries), _pearson, "r double, similarity double", **sizes)


def _similar_first(pieces: pa.Array) -> Callable[[pa.Array], Judged]:
    of = _pearson(pieces)

    def judge(queries: pa.Array) -> Judged:
        (r, similarity), met = of(queries)
        return [similarity, r], met

    return judge


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping distance of two series with absolute differences, row by row in memory of one row."""
    if not len(a) or not len(b):
        return 0.0 if len(a) == len(b) else float("inf")
    return float(warping.distances(np.asarray(a, float), [np.asarray(b, float)])[0])


def lcs(a: np.ndarray, b: np.ndarray, tolerance: float = 0.0) -> int:
    """Length of the longest common subsequence, values being equal within the tolerance; memory of one row."""
    b, row = np.asarray(b, float), np.zeros(len(b) + 1, np.int64)
    for x in np.asarray(a, float):
        found = np.where(np.abs(b - x) <= tolerance, row[:-1] + 1, 0)
        row = np.concatenate([[0], np.maximum.accumulate(np.maximum(found, row[1:]))])
    return int(row[-1])


def lcs_backtrack(a: np.ndarray, b: np.ndarray, tolerance: float = 0.0) -> list[float]:
    """A longest common subsequence, as values of ``a``; where dropping either end is as good, the end of ``b`` is dropped."""
    same = np.abs(np.subtract.outer(np.asarray(a, float), np.asarray(b, float))) <= tolerance
    lengths = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i, line in enumerate(same):
        found = np.where(line, lengths[i, :-1] + 1, 0)
        lengths[i + 1, 1:] = np.maximum.accumulate(np.maximum(found, lengths[i, 1:]))
    out, i, j = [], len(a), len(b)
    while i and j:
        if same[i - 1, j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif lengths[i - 1, j] > lengths[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _histograms(column: pa.Array) -> np.ndarray:
    """Counts of the values in twelve equal bins from 0 to 127."""
    row, _, value = _placed(column)
    inside = (value >= 0) & (value <= 127)
    bins = np.minimum(np.searchsorted(np.linspace(0, 127, 13), value[inside], "right") - 1, 11)
    return np.bincount(row[inside] * 12 + bins, minlength=len(column) * 12).reshape(-1, 12).astype(float)


def _histogram_cosine(pieces: pa.Array) -> Callable[[pa.Array], Judged]:
    """Cosine of the histograms, 0 if either has no counts."""
    a = _histograms(pieces)

    def judge(queries: pa.Array) -> Judged:
        b = _histograms(queries)
        norms = np.outer(np.sqrt((b**2).sum(axis=1)), np.sqrt((a**2).sum(axis=1)))
        return [np.where(norms > 0, b @ a.T / np.where(norms > 0, norms, 1.0), 0.0)], None

    return judge


def _prefix_pearson(pieces: pa.Array) -> Callable[[pa.Array], Judged]:
    """(r + 1) / 2 over the places that both have; r = 0 with fewer than two or without variation."""
    of = _pearson(pieces, apart=False)
    return lambda queries: ([of(queries)[0][1]], None)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x if x is not None else [], float) for x in column.to_pylist()]


def lcs_lengths(query: np.ndarray, codes: np.ndarray, values: np.ndarray, tolerance: float = 0.0) -> np.ndarray:
    """Lengths of the longest common subsequences of a query and many series, the columns of ``codes``: places in ``values``, or its length past a series' end.

    A row of the matrix is the bits of some words, the places where it does not grow; a value of the series changes them by an addition (Hyyrö, "Bit-parallel
    LCS-length computation revisited", 2004), in all series at once.
    """
    words = max(1, -(-len(query) // 64))
    same = np.zeros((len(values) + 1, words * 64), bool)
    same[: len(values), : len(query)] = np.abs(np.subtract.outer(values, query)) <= tolerance
    table = np.packbits(same, axis=1, bitorder="little").view("<u8").T.copy()
    rows = [np.full(codes.shape[1], ~np.uint64(0)) for _ in range(words)]
    for line in codes:
        carry = None
        for k, v in enumerate(rows):
            u = table[k].take(line)
            np.bitwise_and(u, v, out=u)
            total = v + u
            if words > 1:
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            np.subtract(v, u, out=u)
            np.bitwise_or(total, u, out=v)
    kept = sum(np.bitwise_count(v).astype(np.int64) for v in rows)
    return words * 64 - kept


def _in_batches(pieces: pa.Array) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    series = _arrays(pieces)
    lengths = np.array([len(x) for x in series], int)
    return series, lengths, warping.batches(lengths)


def _coded(series: list[np.ndarray], at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Series as columns of places in ``values``, and its length past their ends."""
    codes = np.full((max(len(series[k]) for k in at), len(at)), len(values), np.int64)
    for column, k in zip(codes.T, at):
        column[: len(series[k])] = np.searchsorted(values, series[k])
    return codes


def _common_share(tolerance: float) -> Callable[[pa.Array], Callable[[pa.Array], Judged]]:
    def judge(pieces: pa.Array) -> Callable[[pa.Array], Judged]:
        series, lengths, batches = _in_batches(pieces)
        values = np.unique(np.concatenate(series))
        coded = [(at, _coded(series, at, values)) for at in batches]

        def of(queries: pa.Array) -> Judged:
            asked = _arrays(queries)
            out = np.zeros((len(asked), len(series)))
            for line, query in zip(out, asked):
                for at, codes in coded:
                    line[at] = lcs_lengths(query, codes, values, tolerance) / np.maximum(len(query), lengths[at])
            return [out], None

        return of

    return judge


def similar_tracks_by(
    notes: DataFrame, queries: DataFrame, algorithm: str = "dtw", top: int = 10, feature: str = "interval", tolerance: float = 0.0, least_notes: int = 10, **sizes: int
) -> DataFrame:
    """(algorithm, query, piece_id, rank, similarity): the ``top`` pieces most similar to each query, by "dtw", "lcs", "pearson" (on pitches or
    intervals) or "cosine" (of histograms of pitches); ties by piece. Pieces of fewer than ``least_notes`` notes are left out.
    """
    feature = "pitch" if algorithm == "cosine" else feature
    pieces, asked = warping.series_of(notes, feature, least_notes), warping.series_of(queries, feature, 1)
    if algorithm == "dtw":
        ranked = warping.similar(pieces, asked, top)[0]
    else:
        judge = {"lcs": _common_share(tolerance), "pearson": _prefix_pearson, "cosine": _histogram_cosine}[algorithm]
        ranked = best_tracks(_pairs(pieces, asked, judge, "similarity double", top, **sizes), top)
    return ranked.select(F.lit(algorithm).alias("algorithm"), "query", "piece_id", "rank", F.round("similarity", 9).alias("similarity"))


def best_tracks(scored: DataFrame, top: int = 10, score: str = "similarity") -> DataFrame:
    """(query, piece_id, rank, score): the ``top`` most similar pieces of each query, whatever the measure; ties by piece."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round(score, 9)), "piece_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query", "piece_id", "rank", score)


def compare(notes: DataFrame, first: int, second: int) -> DataFrame:
    """One row: all measures of two pieces, and their common subsequence within a semitone."""
    mine, other = notes.where(F.col("piece_id") == second), notes.where(F.col("piece_id") == first)
    aligned = align_to(mine, other, least_notes=1).join(pearson_to(mine, other), ["query", "piece_id"], "left")
    pair = notes.where(F.col("piece_id").isin(first, second)).groupBy("piece_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "pitch"))), lambda x: x["pitch"]).alias("v")
    )
    both = pair.groupBy().agg(
        F.max(F.when(F.col("piece_id") == second, F.col("v"))).alias("a"), F.max(F.when(F.col("piece_id") == first, F.col("v"))).alias("b")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"common": [[int(x) for x in lcs_backtrack(a, b, 1.0)] for a, b in zip(frame["a"], frame["b"])]})

    return aligned.crossJoin(F.broadcast(both.mapInPandas(run, "common array<int>")))


def resolve_series(
    spark: SparkSession, kind: str, source: DataFrame | list[float] | int | None, name: str | None = None, most: int = 512
) -> DataFrame:
    """(index, value): a series by its kind: "custom" (numbers), "pattern" (the number of a sequence) or "track" (a row of features, and the
    name of one or none for all).
    """
    if kind == "track":
        names = [name] if name else [f.name for f in source.schema.fields if f.dataType.simpleString() == "double"]
        return source.limit(1).select(F.posexplode(F.array(*[F.col(n).cast("double") for n in names])).alias("index", "value"))
    if kind == "pattern":
        from .generators import _double, values

        source = [_double(v) for v in values(source, most)]
    elif kind != "custom":
        raise ValueError(f"no series of kind {kind}")
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate((source or [])[:most])], "index int, value double")


def _aligned(pieces: pa.Array) -> Callable[[pa.Array], Judged]:
    """Warping of the intervals, subsequences of the pitches within a semitone."""
    series, lengths, batches = _in_batches(pieces)
    values = np.unique(np.concatenate(series))
    steps = [np.diff(x) for x in series]
    coded = [(at, _coded(series, at, values)) for at in batches]
    warps = [(at, warping.packed([steps[k] for k in at])) for at in warping.batches(np.maximum(lengths - 1, 0))]

    def of(queries: pa.Array) -> Judged:
        asked = _arrays(queries)
        d, common = np.zeros((len(asked), len(series))), np.zeros((len(asked), len(series)))
        n = np.array([len(x) for x in asked])
        for i, query in enumerate(asked):
            d[i] = np.where((lengths > 1) == (len(query) > 1), 0.0, np.inf)
            for at, columns in warps if len(query) > 1 else ():
                d[i, at] = warping.warped(np.diff(query), columns, lengths[at] - 1)
            for at, codes in coded:
                common[i, at] = lcs_lengths(query, codes, values, 1.0)
        total = np.maximum(np.maximum(n - 1, 0)[:, None] + np.maximum(lengths - 1, 0), 1)
        return [d, np.maximum(0.0, 1 - d / total), common, common / np.maximum(np.maximum.outer(n, lengths), 1)], None

    return of


def align_to(notes: DataFrame, queries: DataFrame, least_notes: int = 10, **sizes: int) -> DataFrame:
    """(query, piece_id, dtw_distance, dtw_similarity, lcs_length, lcs_similarity): every piece of at least ``least_notes`` notes against each
    other piece in ``queries``; warping on intervals, subsequences on pitches within one semitone. warping.similar() finds the most similar
    pieces without computing all of these.
    """
    pieces, asked = warping.series_of(notes, "pitch", least_notes), warping.series_of(queries, "pitch", 1)
    columns = "dtw_distance double, dtw_similarity double, lcs_length int, lcs_similarity double"
    return _pairs(pieces, asked, _aligned, columns, **sizes)


def _buckets(x: np.ndarray, bands: int = BANDS, bits: int = BAND_BITS, seed: int = 42) -> np.ndarray:
    """(row, band): the signs of ``bits`` random projections in each band."""
    planes = np.random.default_rng(seed).standard_normal((x.shape[1], bands * bits))  # row by row, so that each coordinate has its own at any length
    return (x @ planes > 0).reshape(len(x), bands, bits) @ (1 << np.arange(bits))


def lsh_buckets(
    vectors: DataFrame, bands: int = BANDS, bits: int = BAND_BITS, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, band, bucket): the signs of ``bits`` random projections in each band. Rows without a vector have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, float) for v in batch.column(1).to_pylist()]
            x = np.zeros((len(vectors), max(map(len, vectors), default=0)))
            for row, v in zip(x, vectors):
                row[: len(v)] = np.nan_to_num(v)
            buckets = _buckets(x, bands, bits, seed)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), bands)))
            yield pa.record_batch(
                [ids, pa.array(np.tile(np.arange(bands), len(x)), pa.int32()), pa.array(buckets.ravel(), pa.int64())], ["id", "band", "bucket"]
            )

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("v")
    ).where(F.col("v").isNotNull()).mapInArrow(run, f"id {kind}, band int, bucket bigint")


def lsh_search(
    vectors: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = PART_PIECES,
    block_queries: int = SEARCH_QUERIES,
) -> DataFrame:
    """(query, neighbour, rank, score): candidates share a bucket with a query; ranked by cosine, which is 0 for vectors of different lengths or with a
    value that is null or no number. Candidates are found and scored where parts of the rows and blocks of the queries meet, and no pair leaves a task
    before it is among the best of its part.
    """
    a = vectors.select(F.col(id_col).alias("piece_id"), F.col(vector_col).alias("x")).where(F.col("x").isNotNull())
    b = queries.select(F.col(id_col).alias("piece_id"), F.col(vector_col).alias("x")).where(F.col("x").isNotNull())
    found = _pairs(a, b, _in_buckets, "score double", top, part_rows, block_queries)
    found = found.select("query", F.col("piece_id").alias("neighbour"), F.round("score", 9).alias("score"))
    return found.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbour"))
    ).where(F.col("rank") <= top)


def _in_buckets(rows: pa.Array) -> Callable[[pa.Array], Judged]:
    """Cosines of the vectors that share a bucket in any band."""

    def read(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.asarray(column.value_lengths())
        raw = np.full((len(column), max(1, lengths.max(initial=0))), np.nan)
        raw[np.arange(raw.shape[1]) < lengths[:, None]] = np.asarray(column.flatten().cast(pa.float64()), float)
        unit = np.where((np.isfinite(raw) | (np.arange(raw.shape[1]) >= lengths[:, None])).all(axis=1, keepdims=True), np.nan_to_num(raw), 0.0)
        norm = np.linalg.norm(unit, axis=1, keepdims=True)
        return lengths, unit / np.where(norm > 0, norm, 1.0), np.ascontiguousarray(_buckets(np.nan_to_num(raw)).astype(np.uint8).T)

    lengths, x, mine = read(rows)

    def judge(queries: pa.Array) -> Judged:
        sizes, y, theirs = read(queries)
        met = np.zeros((len(y), len(x)), bool)
        for q, r in zip(theirs, mine):
            met |= q[:, None] == r
        width = min(x.shape[1], y.shape[1])
        return [np.where(np.equal.outer(sizes, lengths), y[:, :width] @ x[:, :width].T, 0.0) + 0.0], met

    return judge


def normalized(notes: DataFrame, column: str = "pitch", method: str = "minmax") -> DataFrame:
    """(piece_id, seq, value): min-max, z-score or share of the largest absolute value within a piece; constants give 0."""
    w, x = Window.partitionBy("piece_id"), F.col(column).cast("double")
    span = {
        "minmax": (x - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)), "zscore": (x - F.avg(x).over(w), F.stddev_pop(x).over(w)),
        "max": (x, F.max(F.abs(x)).over(w))
    }[method]
    return notes.select("piece_id", "seq", F.coalesce(span[0] / F.when(span[1] != 0, span[1]), F.lit(0.0)).alias("value"))


def sequence_of(notes: DataFrame, feature: str = "pitch") -> DataFrame:
    """(piece_id, seq, value) of pitch, duration, interval or velocity; notes without velocity have 64."""
    value = {
        "pitch": F.col("pitch"), "duration": F.col("duration"), "interval": F.col("pitch") - F.lag("pitch").over(by_seq()),
        "velocity": F.coalesce(F.col("velocity"), F.lit(64)) if "velocity" in notes.columns else F.lit(64)
    }[feature]
    return notes.select("piece_id", "seq", value.cast("double").alias("value")).where(F.col("value").isNotNull())
