"""Nearest neighbours in phase space against all distances, and tempo marks found by walking a file."""

import time

import numpy as np
import pytest

from cadenza.operators import chaos
from cadenza.sources import midi


def plain_nearest(points, rows, apart):
    out = []
    for i in range(rows):
        d = np.sqrt(sum((points[i, k] - points[:, k]) ** 2 for k in range(points.shape[1])))
        d[np.abs(np.arange(len(points)) - i) <= apart] = np.inf
        if np.isfinite(d).any():
            out.append((i, int(d.argmin())))
    return out


@pytest.mark.parametrize("kind", range(5))
def test_grid_search_equals_all_distances(kind):
    for seed in range(12):
        rng = np.random.default_rng([kind, seed])
        n = int(rng.integers(8, 150))
        series = (rng.integers(0, 3, n), rng.integers(30, 90, n), rng.standard_normal(n), np.full(n, 5), np.append(rng.standard_normal(n - 2), [1e6, -1e6]))
        points = chaos._embed(series[kind].astype(float), 3, 1)
        rows = max(1, len(points) - 3)
        found = chaos.nearest_apart(points, rows, 2)
        assert list(zip(found[0].tolist(), found[1].tolist())) == plain_nearest(points, rows, 2)


@pytest.mark.parametrize("values", [1, 5, 61])
def test_a_long_piece_is_not_compared_pair_by_pair(values):
    x = np.random.default_rng(0).integers(60, 60 + values, 50_000).astype(float)
    begin = time.time()
    assert np.isfinite(chaos.lyapunov(x))
    assert time.time() - begin < 30


def test_tempo_is_set_at_marks_alone(spark):
    data = midi.write([(60, 0, 1, 64, 0), (62, 1, 1, 64, 0)], 90)
    text = b"\x00\xff\x01\x06\xff\x51\x03abc"  # a text that looks like a mark
    at = data.index(b"MTrk") + 8
    data = data[: at - 4] + (int.from_bytes(data[at - 4 : at], "big") + len(text)).to_bytes(4, "big") + text + data[at:]
    files = spark.createDataFrame([("a", data), ("b", b"nothing"), ("c", data[:40])], "path string, content binary")
    got = {r["file"]: r for r in midi.normalized_tempo(files, 120.0).collect()}
    assert bytes(got["a"]["content"]).count(b"\xff\x51\x03abc") == 1 and midi.tempi(bytes(got["a"]["content"])) == [(0.0, 120.0)] and got["a"]["marks"] == 1
    assert midi.parse(bytes(got["a"]["content"])) == midi.parse(data)
    assert bytes(got["b"]["content"]) == b"nothing" and got["b"]["error"] and got["b"]["marks"] is None
