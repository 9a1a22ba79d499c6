"""Nearest neighbours by blocks and by index, and warping that prunes, against plain computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import neighbours, warping
from cadenza.operators import similarity as sim


def plain_dtw(a, b):
    total = np.full((len(a) + 1, len(b) + 1), np.inf)
    total[0, 0] = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            total[i, j] = abs(a[i - 1] - b[j - 1]) + min(total[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
    return total[-1, -1]


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1", "check_s"])
def test_index_finds_nine_of_ten_with_a_tenth_scored(spark, folder):
    v = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").select("vec_id", "embedding")
    q, n = v.where("vec_id % 20 = 0"), v.count()
    pairs = lambda d: {tuple(r) for r in d.select("query", "neighbour").collect()}
    exact, found = pairs(neighbours.exact(v, q)), pairs(neighbours.search(v, q))
    recall, scored = len(exact & found) / len(exact), 40 / n
    print(folder, "recall", recall, "share of rows scored", scored)
    assert recall >= 0.9 and scored < 0.1 and len(found) == 10 * q.count()


def test_lists_and_parts_do_not_lose_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 16)) * 3
    rows = [(k, [float(x) for x in centres[0 if k % 3 else k % 6] + rng.standard_normal(16)]) for k in range(900)]  # two thirds in one list
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "LIST_ROWS", 100)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 16)
    q = v.where("vec_id % 20 = 0")
    exact = {tuple(r) for r in neighbours.exact(v, q, part_rows=70).select("query", "neighbour", "rank").collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain = set()
    for k in range(0, 900, 20):
        scores = np.round(x[k] @ x.T, 9)
        scores[k] = -9
        plain |= {(k, int(j), n + 1) for n, j in enumerate(np.lexsort((np.arange(900), -scores))[:10])}
    assert exact == plain
    model = neighbours.fit(v)
    assert len(model.centres) > 1 and model.probes < len(model.centres)
    found = {tuple(r) for r in neighbours.search(v, q, model=model, part_rows=50).select("query", "neighbour", "rank").collect()}
    assert len({x[:2] for x in found} & {x[:2] for x in exact}) >= 0.9 * len(exact)


def test_vectors_without_direction_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query"], r["neighbour"]): (r["rank"], r["score"]) for r in neighbours.exact(v, v.where("vec_id = 1"), top=5).collect()}
    assert got[1, 2][0] == 1 and got[1, 3] == (2, 0.0) and got[1, 4] == (3, 0.0) and got[1, 5] == (4, 0.0) and got[1, 6] == (5, -1.0)
    assert neighbours.search(v, v.where("vec_id = 1"), top=5).count() == 5
    assert neighbours.exact(v.limit(0), v.limit(0)).count() == 0 == neighbours.search(v.limit(0), v.limit(0)).count()


def test_distances_are_those_of_the_full_matrix():
    rng = np.random.default_rng(3)
    for _ in range(40):
        q = rng.integers(-9, 9, rng.integers(1, 30)).astype(float)
        others = [rng.integers(-9, 9, rng.integers(1, 30)).astype(float) for _ in range(9)]
        want = np.array([plain_dtw(q, x) for x in others])
        assert np.allclose(warping.distances(q, others), want)
        assert all(warping.Series(q).bound(warping.Series(x)) <= w + 1e-9 for x, w in zip(others, want))
        most = np.median(want)
        assert np.allclose(warping.distances(q, others, np.full(9, most)), np.where(want <= most, want, np.inf))
    assert sim.lcs(np.arange(50_000), np.arange(3)) == 3  # one row of memory


@pytest.mark.parametrize("spread, part", [(2, 512), (2, 7), (20, 7)])
def test_pruned_search_returns_what_all_full_distances_give(spark, spread, part):
    rng = np.random.default_rng(spread)
    rows = [(p, [float(x) for x in rng.integers(-spread, spread + 1, rng.integers(9, 40))]) for p in range(90)] + [(90, []), (91, [0.0]), (92, [])]
    series = spark.createDataFrame(rows, "piece_id long, x array<double>")
    queries = series.where("piece_id % 20 = 0 OR piece_id = 90")
    found, fate = warping.similar(series, queries, part_series=part, block_queries=2)
    want = set()
    for q, x in rows:
        if q % 20 == 0 or q == 90:
            scores = []
            for p, y in rows:
                if p != q:
                    d = plain_dtw(x, y) if x and y else 0.0 if not x and not y else np.inf
                    scores.append((-round(max(0.0, 1 - d / max(len(x) + len(y), 1)), 9), p))
            want |= {(q, p, k + 1, -s) for k, (s, p) in enumerate(sorted(scores)[:10])}
    assert {tuple(r) for r in found.collect()} == want
    for r in fate.collect():
        assert r["pairs"] == len(rows) - 1 == r["by_bound"] + r["given_up"] + r["warped"]


def test_pieces_search_equals_the_alignment_of_all_pairs(spark, sf_dir):
    from cadenza.sources import views

    notes = views.notes(spark, "/root/testdata/sf0.01")
    series = warping.series_of(notes)
    found, _ = warping.similar(series, series.where("piece_id % 20 = 0"))
    every = sim.best_tracks(sim.align_to(notes, notes.where("piece_id % 20 = 0")), score="dtw_similarity")
    rows = lambda d, s: {(r["query"], r["piece_id"], r["rank"], round(r[s], 9)) for r in d.collect()}
    assert rows(found, "similarity") == rows(every, "dtw_similarity")


def test_longest_first_queries_in_blocks(spark):
    v = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 2)).alias("embedding"))
    one = {tuple(r) for r in neighbours.exact(v, v, part_rows=7).collect()}
    assert one == {tuple(r) for r in neighbours.exact(v, v).collect()} and len(one) == 500
