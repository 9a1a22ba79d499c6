"""Measures of many pairs at once equal those of one pair at a time, and searches return no more than the best of each part."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.operators import similarity as sim
from cadenza.operators import warping


def _notes(spark, pieces):
    return spark.createDataFrame([(p, k, x) for p, v in pieces.items() for k, x in enumerate(v)], "piece_id long, seq int, pitch int")


def test_index_search_joins_no_pairs_and_finds_what_shared_buckets_give(spark):
    rng = np.random.default_rng(7)
    rows = [(k, rng.standard_normal(16).tolist()) for k in range(300)] + [(300, None), (301, [1.0] * 5), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, [1.0] * 15 + [None])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.where("vec_id % 20 = 0")
    found = sim.lsh_search(v, q, part_rows=70, block_queries=4)
    assert "Join" not in found._jdf.queryExecution().toString()
    buckets = {}
    for r in sim.lsh_buckets(v, id_col="vec_id").collect():
        buckets.setdefault(r["id"], set()).add((r["band"], r["bucket"]))
    want, vectors = set(), dict(rows)
    for a in range(0, 300, 20):
        scored = []
        for b, x in rows:
            if b != a and b in buckets and buckets[a] & buckets[b]:
                fits = len(x) == 16 and None not in x and np.isfinite(x).all() and np.linalg.norm(x) > 0
                scored.append((-round(float(np.dot(x, vectors[a]) / np.linalg.norm(x) / np.linalg.norm(vectors[a])), 9) if fits else 0.0, b))
        want |= {(a, b, k + 1, round(-s + 0.0, 7)) for k, (s, b) in enumerate(sorted(scored)[:10])}
    assert {(r["query"], r["neighbour"], r["rank"], round(r["score"], 7)) for r in found.collect()} == want


@pytest.mark.parametrize("measure", ["histogram", "pearson"])
def test_only_the_best_of_each_part_leave_a_task(spark, measure):
    rng = np.random.default_rng(8)
    notes = _notes(spark, {p: rng.integers(40, 44, 12).tolist() for p in range(200)})
    judge = {"histogram": sim._histogram_cosine, "pearson": sim._prefix_pearson}[measure]
    pieces = warping.series_of(notes, "pitch")
    met = sim._pairs(pieces, pieces.where("piece_id % 20 = 0"), judge, "similarity double", 3, part_pieces=50)
    assert met.count() == 10 * 4 * 3
    every = sim._pairs(pieces, pieces.where("piece_id % 20 = 0"), judge, "similarity double")
    rows = lambda d: {tuple(r) for r in sim.best_tracks(d, 3).select("query", "piece_id", "rank").collect()}
    assert every.count() == 10 * 199 and rows(met) == rows(every)


def test_most_similar_of_each_part_are_the_most_similar_of_all(spark):
    rng = np.random.default_rng(9)
    notes = _notes(spark, {p: rng.integers(40, 43, rng.integers(2, 9)).tolist() for p in range(120)})
    q = notes.where("piece_id % 20 = 0")
    rows = lambda d: {tuple(r) for r in sim.best_tracks(d, 5).select("query", "piece_id", "rank").collect()}
    first = sim.pearson_to(notes, q, top=5, part_pieces=40)
    assert first.count() <= 6 * 3 * 5 and rows(first) == rows(sim.pearson_to(notes, q))


@pytest.mark.parametrize("column", ["pitch", "value"])
def test_correlation_by_products_of_matrices(spark, column):
    rng = np.random.default_rng(10)
    rows = []
    for p in range(30):
        for k in rng.permutation(40)[: rng.integers(1, 30)].tolist():
            flat = p % 5 == 0
            rows.append((p, k, None if rng.random() < 0.1 else 60 if flat else int(rng.integers(50, 70)), 1e6 + (0.1 if flat else float(rng.random()) * 1e-3)))
    notes = spark.createDataFrame(rows, "piece_id long, seq int, pitch int, value double")
    got = {(r["query"], r["piece_id"]): r["r"] for r in sim.pearson_to(notes, notes.where("piece_id % 20 = 0"), column).collect()}
    series = {p: {k: v for q, k, *x in rows if q == p for v in [x[0] if column == "pitch" else x[1]]} for p in range(30)}
    for a in (0, 20):
        for b in range(30):
            if a == b or series[a].keys().isdisjoint(series[b]):
                assert (a, b) not in got
                continue
            x, y = np.array([(v, series[b][k]) for k, v in series[a].items() if k in series[b] and v is not None and series[b][k] is not None], float).reshape(-1, 2).T
            want = np.corrcoef(x, y)[0, 1] if len(x) > 1 and np.ptp(x) and np.ptp(y) else 0.0
            assert abs(got[a, b] - want) < 1e-6, (a, b)


@pytest.mark.parametrize("scale", [1.0, 0.25])
def test_alignment_of_many_equals_that_of_each_pair(scale):
    rng = np.random.default_rng(11)
    pieces = [(rng.integers(40, 60, n) * scale).tolist() for n in (1, 2, 3, 64, 65, 130, 200, 40)]
    of = sim._aligned(pa.array(pieces, pa.list_(pa.float64())))
    (d, _, common, share), met = of(pa.array(pieces, pa.list_(pa.float64())))
    assert met is None
    for i, q in enumerate(pieces):
        for j, x in enumerate(pieces):
            assert abs(d[i, j] - sim.dtw(np.diff(x), np.diff(q))) < 1e-9 or d[i, j] == sim.dtw(np.diff(x), np.diff(q))
            assert common[i, j] == sim.lcs(np.array(x), np.array(q), 1.0) and share[i, j] == common[i, j] / max(len(x), len(q))


@pytest.mark.parametrize("scale", [1.0, 0.3, 40_000.0])
def test_distances_within_a_limit_and_bounds_of_all_pairs(scale):
    rng = np.random.default_rng(12)
    series = [rng.integers(-30, 30, rng.integers(1, 60)) * scale for _ in range(60)]
    columns, lengths = warping.packed(series), np.array([len(x) for x in series])
    for q in series[:8]:
        full = warping.warped(q, columns, lengths)
        assert np.allclose(full, [plain(q, x) for x in series])
        for share in (0.05, 0.5, 1.0):
            most = np.quantile(full, share) * rng.uniform(0.8, 1.2, len(full))
            got = warping.within(q, columns, lengths, most)
            assert np.allclose(got, np.where(full <= most, full, np.inf))
    all_ = [warping.Series(x) for x in [*series, []]]
    bounds = warping.bounds(all_, all_)
    assert bounds[-1, -1] == 0 and np.isinf(bounds[-1, :-1]).all() and np.isinf(bounds[:-1, -1]).all()
    assert np.allclose(bounds[:-1, :-1], [[a.bound(b) for b in all_[:-1]] for a in all_[:-1]])


def plain(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = abs(x - y) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


def test_rows_without_an_id_are_not_searched(spark):
    notes = spark.createDataFrame([(p, k, 50 + k) for p in (0, 1, None) for k in range(12)], "piece_id long, seq int, pitch int")
    assert [tuple(r)[:2] for r in sim.pearson_to(notes, notes.where(F.col("piece_id") == 0)).collect()] == [(0, 1)]
