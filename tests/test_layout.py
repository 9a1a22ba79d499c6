"""Layouts keep more of the neighbourhoods than the principal plane does, and come out the same again."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import layout, neighbours


def near(points, k=10):
    squared = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    np.fill_diagonal(squared, np.inf)
    return np.argsort(squared, axis=1, kind="stable")[:, :k]


def kept(points, want):
    return np.mean([len(set(a) & set(b)) / len(b) for a, b in zip(near(points), want)])


def placed(frame):
    return np.array([(r["x"], r["y"]) for r in sorted(frame.collect(), key=lambda r: r["id"])])


@pytest.mark.parametrize("folder, block_rows, times", [("sf0.01", 4096, 2.5), ("sf0.01", 120, 1.8), ("sf0.1", 4096, 2.5)])
def test_layout_keeps_neighbourhoods(spark, folder, block_rows, times):
    v = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    x = np.array([r["embedding"] for r in v.orderBy("vec_id").collect()], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = near(x)
    plane = (x - x.mean(axis=0)) @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2].T
    y = placed(layout.layout(v, block_rows=block_rows))
    print(folder, block_rows, "kept", kept(y, want), "by the principal plane", kept(plane, want))
    assert kept(y, want) > times * kept(plane, want)  # blocks dealt by a hash, not by nearness, keep fewer


def test_layout_is_repeatable_and_takes_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(z) for z in rng.standard_normal(6)]) for k in range(60)] + [(60, None), (61, [0.0] * 6), (62, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one, two = placed(layout.layout(v, near=10, perplexity=4, rounds=3)), placed(layout.layout(v.repartition(5), near=10, perplexity=4, rounds=3))
    assert one.shape == (63, 2) and np.isfinite(one).all() and np.allclose(one, two)
    assert layout.layout(v.limit(0), rounds=1).count() == 0


def test_affinities_have_the_wanted_perplexity():
    rng = np.random.default_rng(2)
    w = layout.affinities(rng.random((20, 30)), 8.0)
    entropy = -(w * np.log(np.maximum(w, 1e-300))).sum(axis=1)
    assert np.allclose(np.exp(entropy), 8.0, rtol=1e-3) and np.allclose(w.sum(axis=1), 1)
    assert np.allclose(layout.affinities(np.array([[1.0, np.inf, np.inf]]), 8.0), [[1, 0, 0]])


def test_search_of_all_rows_returns_the_nearest(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 8))
    x[500:540] = x[500]  # copies
    rows = [(f"v{k:03d}", [float(z) for z in v]) for k, v in enumerate(x)] + [("none", None), ("zero", [0.0] * 8)]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    monkeypatch.setattr(neighbours, "LIST_ROWS", 100)
    monkeypatch.setattr(neighbours, "PART_ROWS", 64)
    monkeypatch.setattr(neighbours, "PART_SIZE", 8 * 250)
    monkeypatch.setattr(neighbours, "BLOCK_SIZE", 8 * 200)
    monkeypatch.setattr(neighbours, "TILE", 77)
    model = neighbours.fit(v, 0.9, 12)
    assert 1 < model.probes < len(model.centres)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(x @ x.T, 6)
    np.fill_diagonal(scores, -9)
    held = neighbours._closest(x, model.centres)
    for part, reach in ((model, [set(r) for r in model.lists(x).tolist()]), (dataclasses.replace(model, probes=len(model.centres)), [set(held)] * 900)):
        found = {r["id"]: r for r in neighbours.neighbours_of_all(v, part, 12).collect()}
        assert len(found) == 900 and not {"none", "zero"} & set(found)
        for k in range(900):
            got = [int(i[1:]) for i in found[f"v{k:03d}"]["near"]]
            want = np.sort(scores[k][[h in reach[k] for h in held]])[::-1][:12]  # copies tie, so scores are compared
            assert len(set(got)) == 12 and np.allclose(scores[k][got], want, atol=2e-6) and np.allclose(found[f"v{k:03d}"]["score"], want, atol=2e-6)


def test_blocks_hear_where_their_neighbours_are(spark):
    rng = np.random.default_rng(4)
    near = {k: [int(j) for j in rng.permutation(200)[: k % 7]] for k in range(200)}
    rows = [(k, k % 5, float(rng.integers(0, 1000)), float(k), near[k] or None, [0.5] * len(near[k]) or None) for k in range(200)]
    rows = spark.createDataFrame(rows, "id long, block long, x double, y double, near array<long>, weight array<float>")
    steady = layout._steady(rows, "bigint")
    at = rows.select("block", F.lit(None).cast("long").alias("other"), "id", F.array("x", "y", F.lit(0.0), F.lit(0.0)).alias("p"), F.lit(None).cast("array<float>").alias("sent"))
    steady, at = steady.collect(), layout._round(at, steady, "bigint", 200, 7, 1, 0, 1.0).collect()
    place = {r["id"]: tuple(r["p"][:2]) for r in at if r["other"] is None}
    assert place == {r["id"]: (r["x"], r["y"]) for r in rows.collect()}
    for block in range(5):
        known = [place[k] for k in range(200) if k % 5 == block]
        for r in sorted((r for r in at if r["block"] == block and r["other"] is not None), key=lambda r: r["other"]):
            known += list(zip(r["sent"][::2], r["sent"][1::2]))
        lines = [r for r in steady if r["block"] == block and r["other"] is None]
        assert len(lines) == 40
        for r in lines:
            assert [known[j] for j in r["near"] or []] == [place[j] for j in near[r["id"]]]


def test_disk_of_a_layout_stays_small(spark, monkeypatch):
    """Candidates of each list, joined to vectors, and edges, joined three times a round, wrote 3167 bytes for each row here, and more with more lists."""
    monkeypatch.setattr(neighbours, "LIST_ROWS", 100)
    v = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.randn(k) for k in range(64)]).alias("embedding"))
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getPath(): f.length() for f in (lambda x: [x.apply(k) for k in range(x.length())])(disk.getAllFiles())}
    before = files()
    assert layout.layout(v, rounds=2).count() == 3000
    written = sum(size for path, size in files().items() if path not in before)
    print("bytes of shuffle for each row", written / 3000)
    assert written < 1500 * 3000
