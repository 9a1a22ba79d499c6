"""Operators on hand-made sequences, and numpy re-derivations."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.operators import chaos, features, forms, games, generators, models, motifs, series, similarity, statistics


def notes(spark, pieces):
    rows = []
    for piece, (pitches, durations) in enumerate(pieces):
        start = 0.0
        for seq, (p, d) in enumerate(zip(pitches, durations)):
            rows.append((piece, seq, p, d, start))
            start += d
    return spark.createDataFrame(rows, "piece_id long, seq int, pitch int, duration double, start double")


def ones(*pitches):
    return list(pitches), [1.0] * len(pitches)


def test_features_of_small_pieces(spark):
    n = notes(spark, [ones(60), ones(60, 60, 60, 60), ones(60, 72), ones(60, 61, 60, 61), ones(60, 62, 64, 65, 67, 69, 71, 72)])
    pitch = {r.piece_id: r for r in features.pitch_features(n).collect()}
    interval = {r.piece_id: r for r in features.interval_features(n).collect()}
    harmony = {r.piece_id: r for r in features.harmony_features(n).collect()}
    assert pitch[1].pitch_entropy == 0 and pitch[1].tonal_center_strength == 1 and pitch[3].pitch_entropy == pytest.approx(1) and pitch[2].pitch_range == 12 and pitch[4].chromatic_saturation == 7
    assert interval[0].interval_entropy == 0 and interval[0].step_ratio == 0 and interval[1].step_ratio == 1 and interval[2].leap_ratio == 1 and interval[4].directional_bias == 1 and interval[4].mean_interval == pytest.approx(12 / 7)
    assert harmony[0].dissonance_index == 1 and harmony[2].consonance_score == 1 and harmony[3].consonance_score == 0
    spectrum = {r.piece_id: r for r in features.spectral_features(n).collect()}
    assert (spectrum[1].spectral_centroid, spectrum[1].spectral_flatness) == (0, 0)
    assert {r.piece_id: r.fractal_dimension for r in features.fractal_dimension(n).collect()}[2] == 1.0


def test_half_ties_go_to_even(spark):
    steps = features.with_steps(notes(spark, [([60, 60, 60], [0.125, 0.375, 0.625])])).orderBy("seq").collect()
    assert [r.q for r in steps] == [0.0, 0.5, 0.5]


def test_smoothers_on_small_series(spark):
    n = notes(spark, [ones(10, 20), ones(1, 9, 2)])
    value = lambda name, piece, **p: [r.smoothed for r in sorted(series.run(n, name, **p).where(f"piece_id = {piece}").collect(), key=lambda r: r.seq)]
    assert value("ema", 0, alpha=0.3) == [10, pytest.approx(13)]
    assert value("rolling_median", 1, size=3) == [9, 2, 9]
    assert value("savitzky_golay", 1)[1] == pytest.approx(np.dot([1, 1, 9, 2, 2], list(series.savitzky_golay_weights().values())))
    assert sum(series.gaussian_weights().values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        series.run(n, "unknown")
    with pytest.raises(ValueError):
        series.run(n, "ema", beta=1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 20), min_size=1, max_size=15), st.lists(st.integers(0, 20), min_size=1, max_size=15))
def test_alignment_against_plain_tables(a, b):
    x, y = np.array(a), np.array(b)
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    common = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = abs(a[i - 1] - b[j - 1]) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
            common[i, j] = common[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(common[i - 1, j], common[i, j - 1])
    assert similarity.dtw(x, y) == d[-1, -1] == similarity.dtw(y, x) and similarity.dtw(x, x) == 0
    assert similarity.lcs(x, y) == common[-1, -1] <= min(len(a), len(b))
    assert similarity.lcs(np.array([1, 2, 3, 4]), np.array([2, 4])) == 2


def test_chords_keys_and_palindromes(spark):
    assert forms.chord_of([60, 64, 67]) == (0, "major") and forms.chord_of([60, 63, 67]) == (0, "minor") and forms.chord_of([60, 63, 66]) is None and forms.chord_of([60, 63, 66], extended=True) == (0, "diminished")
    assert forms.key_of([0, 7, 0, 5]) == (0, False) and forms.key_of([]) == (0, False)
    n = notes(spark, [ones(60, 62, 64, 62, 60), ones(1, 2, 3, 4)])
    found = {(r.kind, r.start, r.length) for r in forms.palindromes(n).where("piece_id = 0").collect()}
    assert ("melodic", 0, 5) in found and {x for x in found if x[0] == "intervallic"} == {
        ("intervallic", 0, 4), ("intervallic", 1, 4), ("intervallic", 0, 5)
    }
    mirrored = notes(spark, [ones(*range(60, 68), *reversed(range(60, 68))), ones(*range(60, 76))])
    assert {r.piece_id: r.has_retrograde for r in forms.retrograde_motion(mirrored).collect()} == {0: True, 1: False}


def test_games_and_motifs(spark):
    n = notes(spark, [ones(*([60, 67] * 20)), ones(*([60, 61] * 20))])
    payoff = {r.piece_id: r for r in games.iterated_payoffs(n).collect()}
    assert payoff[0].mean_payoff == pytest.approx(0.9) and payoff[0].cooperation_rate == 1 and payoff[1].defection_rate == 1 and payoff[1].tit_for_tat_score == 1
    assert games.equilibrium().sum() == pytest.approx(1)
    mined = motifs.mine(n, 3, 4, 3, 5, 5).collect()
    assert {r.pattern for r in mined if r.piece_id == 0 and r.length == 3} <= {"7,-7,7", "-7,7,-7"} and mined
    assert [(r.pattern, r.z) for r in mined] == [(r.pattern, r.z) for r in motifs.mine(n, 3, 4, 3, 5, 5).collect()]


def test_phase_space_measures():
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    assert 0.3 < chaos.hurst(x) < 0.8 and chaos.hurst(np.cumsum(x)) > 0.8 and chaos.hurst(x[:10]) == 0.5
    wave = np.sin(np.arange(200) * 0.3)
    assert chaos.recurrence_measures(chaos.recurrence(wave))["determinism"] > 0.9 > chaos.recurrence_measures(chaos.recurrence(x))["determinism"]
    assert chaos.lyapunov(x[:10]) == 0 and 0.5 < chaos.correlation_dimension(wave) < 1.5
    hit = np.eye(6, dtype=bool)
    assert chaos.recurrence_measures(hit) == {"recurrence_rate": 0.0, "determinism": 0.0, "laminarity": 0.0, "recurrence_entropy": 0.0}


def test_p_values():
    assert statistics.t_p_value(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    assert statistics.f_p_value(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-5)
    assert statistics.r_p_value(0.0, 20) == pytest.approx(1) and statistics.incomplete_beta(2, 3, 1) == 1


def test_sequences():
    assert generators.values(1, 8) == [1, 1, 2, 3, 5, 8, 13, 21] and generators.values(8, 8) == [1, 1, 2, 1, 3, 2, 3, 1] and generators.values(19, 6) == [0, 0, 1, 3, 6, 2]
    assert generators.values(9, 4) == [2, 3, 7, 43] and len(
        str(generators.values(9, 12)[-1])
    ) == 417 and generators.values(47, 8) == [0, 1, 0, 1, 1, 0, 1, 1]
    assert all(len(generators.values(k, 12)) == 12 for k in range(1, 101) if k not in (71, 72, 78))
    assert generators.values(97, 12)[-1] == pytest.approx(math.e, abs=1e-6)


def test_suggestions_generation_and_components(spark):
    n = notes(spark, [ones(60, 62, 64, 65, 67)])
    first = models.suggest_next(n, models.markov_matrix(n)).collect()
    assert [r.rank for r in first] == [1, 2, 3, 4, 5] and all(36 <= r.pitch < 97 for r in first) and [r.score for r in first] == sorted(
        (r.score for r in first), reverse=True
    )
    walk = models.generate(spark, np.zeros((12, 12)), 2, 10).collect()
    assert walk == models.generate(spark, np.zeros((12, 12)), 2, 10).collect() and len(walk) == 20
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3)) @ np.array([[2, 1, 0], [0, 1, 0], [0, 0, 0.1]])
    rows = models.principal_components(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"], 2, scale=False).toPandas()
    values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert rows[["pc1", "pc2"]].var(ddof=0).to_numpy() == pytest.approx(values[:2])


def test_consonance_that_lies_on_a_bound_does_not_depend_on_how_rows_are_sorted(spark):
    from cadenza.operators import features

    rng = np.random.default_rng(13)
    pieces = {p: rng.integers(40, 90, 41).tolist() for p in range(200)}
    notes = spark.createDataFrame(
        [(p, k, x, float(d), float(k)) for p, v in pieces.items() for k, (x, d) in enumerate(zip(v, rng.integers(1, 17, 41) / 8))], "piece_id long, seq int, pitch int, duration double, start double"
    )
    got = {r["piece_id"]: (r["consonance_score"], r["dissonance_index"]) for r in features.feature_matrix(notes).select("piece_id", "consonance_score", "dissonance_index").collect()}
    for p, v in pieces.items():
        total = 0.0
        for a, b in zip(v, v[1:]):
            total += features.CONSONANCE[abs(b - a) % 12]
        assert got[p] == (total / 40, 1.0 - total / 40), p
