"""Queries of the feature layers."""

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..operators import features as op
from ..sources import views
from ..sources.views import NOTES_SQL, PIECES_SQL

_PC = ", ".join(f"count(*) FILTER (WHERE pitch % 12 = {k}) AS c{k}" for k in range(12))
_ENT = " + ".join(f"CASE WHEN c{k} > 0 THEN -(c{k} / n) * log2(c{k} / n) ELSE 0 END" for k in range(12))
STEPS_SQL = NOTES_SQL + """,
steps AS (SELECT *, pitch - lag(pitch) OVER w AS iv, start - lag(start) OVER w AS gap, round_even(duration * 4, 0) / 4 AS q FROM notes WINDOW w AS (PARTITION BY piece_id ORDER BY seq))"""
PITCH_SQL = f"""
pcs AS (SELECT piece_id, CAST(count(*) AS DOUBLE) AS n, {_PC}, max(pitch) - min(pitch) AS r, avg(pitch) AS m, stddev_pop(pitch) AS s, count(DISTINCT pitch % 12) AS d FROM notes GROUP BY piece_id),
f_pitch AS (SELECT piece_id, {_ENT} AS pitch_entropy, greatest({", ".join(f"c{k}" for k in range(12))}) / n AS tonal_center_strength, r AS pitch_range, m AS pitch_mean, s AS pitch_std, d AS chromatic_saturation, {", ".join(f"c{k} / n AS pc_{k}" for k in range(12))} FROM pcs)"""
INTERVAL_SQL = """
ivs AS (SELECT piece_id, greatest(least(iv, 12), -12) AS b, count(*) AS c FROM steps WHERE iv IS NOT NULL GROUP BY ALL),
ive AS (SELECT piece_id, -sum(p * log2(p)) AS interval_entropy FROM (SELECT piece_id, c / sum(c) OVER (PARTITION BY piece_id) AS p FROM ivs) AS x GROUP BY piece_id),
f_interval AS (SELECT piece_id, interval_entropy, coalesce(sum(sign(iv)) / nullif(count(*) FILTER (WHERE iv <> 0), 0), 0) AS directional_bias, avg(CASE WHEN abs(iv) <= 2 THEN 1.0::DOUBLE ELSE 0 END) AS step_ratio,
  avg(CASE WHEN abs(iv) > 4 THEN 1.0::DOUBLE ELSE 0 END) AS leap_ratio, avg(abs(iv)) AS mean_interval, stddev_pop(abs(iv)) AS interval_std FROM steps JOIN ive USING (piece_id) WHERE iv IS NOT NULL GROUP BY piece_id, interval_entropy)"""
_CONS = "(CAST([" + ", ".join(str(c) for c in op.CONSONANCE) + "] AS DOUBLE[]))"
HARMONY_SQL = f"""
f_harmony AS (SELECT piece_id, avg({_CONS}[CAST(abs(iv) % 12 AS INTEGER) + 1]) AS consonance_score, 1 - avg({_CONS}[CAST(abs(iv) % 12 AS INTEGER) + 1]) AS dissonance_index, stddev_pop(duration) AS duration_variance FROM steps GROUP BY piece_id)"""
RHYTHM_SQL = """
qs AS (SELECT piece_id, -sum(p * log2(p)) AS rhythmic_entropy FROM (SELECT piece_id, count(*) / sum(count(*)) OVER (PARTITION BY piece_id) AS p FROM steps GROUP BY piece_id, q) AS x GROUP BY piece_id),
f_rhythm AS (SELECT piece_id, rhythmic_entropy, count(*) / (max(start) + arg_max(duration, seq)) AS note_density, stddev_pop(duration) / (avg(duration) + 1e-8) AS syncopation_estimate,
  stddev_pop(gap) / (avg(gap) + 1e-8) AS tempo_variance, avg(duration) AS duration_mean, stddev_pop(duration) AS duration_std FROM steps JOIN qs USING (piece_id) GROUP BY piece_id, rhythmic_entropy)"""
FRACTAL_SQL = """
fp AS (SELECT piece_id, seq, count(*) OVER w AS n, (pitch - min(pitch) OVER w) / (max(pitch) OVER w - min(pitch) OVER w + 1e-8::DOUBLE) AS p FROM notes WINDOW w AS (PARTITION BY piece_id)),
fb AS (SELECT piece_id, s, count(DISTINCT (CAST(trunc(seq / (n / CAST(s AS DOUBLE))) AS INTEGER), CAST(trunc(p * s) AS INTEGER))) AS c FROM fp, (SELECT unnest(range(2, 9)) AS s) AS y GROUP BY piece_id, s),
f_fractal AS (SELECT piece_id, -regr_slope(ln(c), ln(1.0::DOUBLE / s)) AS fractal_dimension FROM fb GROUP BY piece_id)"""
REPETITION_SQL = """
wn AS (SELECT piece_id, count(*) AS n FROM notes GROUP BY piece_id),
wh AS (SELECT a.piece_id, a.seq AS i, b.pitch % 12 AS pc, CAST(count(*) AS DOUBLE) AS c FROM notes AS a JOIN notes AS b ON a.piece_id = b.piece_id AND b.seq BETWEEN a.seq AND a.seq + 19 JOIN wn ON wn.piece_id = a.piece_id WHERE a.seq < n - 20 GROUP BY ALL),
wl AS (SELECT piece_id, i, sqrt(sum(c * c)) AS l FROM wh GROUP BY ALL),
wp AS (SELECT x.piece_id, x.i, y.i AS j, sum(x.c * y.c) AS d FROM wh AS x JOIN wh AS y ON x.piece_id = y.piece_id AND x.pc = y.pc AND y.i >= x.i + 5 GROUP BY ALL),
wq AS (SELECT a.piece_id, sum(coalesce(d, 0) / (a.l * b.l)) AS s, count(*) AS k FROM wl AS a JOIN wl AS b ON a.piece_id = b.piece_id AND b.i >= a.i + 5 LEFT JOIN wp ON wp.piece_id = a.piece_id AND wp.i = a.i AND wp.j = b.i GROUP BY ALL),
f_repetition AS (SELECT wn.piece_id, CASE WHEN n - 20 < 10 THEN 0 ELSE coalesce(s / k, 0) END AS repetition_index FROM wn LEFT JOIN wq USING (piece_id))"""
SPECTRAL_SQL = """
sp AS (SELECT piece_id, seq, pitch - avg(pitch) OVER w AS x, count(*) OVER w AS n FROM notes WINDOW w AS (PARTITION BY piece_id)),
sk AS (SELECT piece_id, n, k, power(sum(x * cos(2 * pi() * k * seq / n)), 2) + power(sum(x * sin(2 * pi() * k * seq / n)), 2) AS p FROM sp, (SELECT unnest(range(0, 200)) AS k) AS y WHERE k <= n // 2 GROUP BY ALL),
st AS (SELECT *, sum(p) OVER (PARTITION BY piece_id) AS t FROM sk),
f_spectral AS (SELECT piece_id, sum(k * p) / max(t) AS spectral_centroid, -sum(CASE WHEN p / t > 1e-25 THEN p / t * log2(p / t) ELSE 0 END) AS spectral_entropy, CAST(arg_max(k, p) AS DOUBLE) AS dominant_frequency,
  exp(avg(ln(p + 1e-8))) / (avg(p) + 1e-8) AS spectral_flatness FROM st GROUP BY piece_id)"""

PITCH = ["pitch_entropy", "tonal_center_strength", "pitch_range", "pitch_mean", "pitch_std", "chromatic_saturation", *[f"pc_{k}" for k in range(12)]]
INTERVAL = ["interval_entropy", "directional_bias", "step_ratio", "leap_ratio", "mean_interval", "interval_std"]
HARMONY = ["consonance_score", "dissonance_index", "duration_variance"]
RHYTHM = ["rhythmic_entropy", "note_density", "syncopation_estimate", "tempo_variance", "duration_mean", "duration_std"]
STRUCTURAL = ["repetition_index", "fractal_dimension", "unique_pitch_classes", "total_notes"]
SPECTRAL = ["spectral_centroid", "spectral_entropy", "dominant_frequency", "spectral_flatness"]
MATRIX = PITCH + INTERVAL + HARMONY + RHYTHM + STRUCTURAL + SPECTRAL
#: Every feature, unrounded, as the table "matrix".
MATRIX_SQL = f"""{STEPS_SQL}, {PITCH_SQL}, {INTERVAL_SQL}, {HARMONY_SQL}, {RHYTHM_SQL}, {FRACTAL_SQL}, {REPETITION_SQL}, {SPECTRAL_SQL}, {PIECES_SQL},
matrix AS (SELECT *, chromatic_saturation AS unique_pitch_classes, n AS total_notes FROM f_pitch JOIN f_interval USING (piece_id) JOIN f_harmony USING (piece_id) JOIN f_rhythm USING (piece_id) JOIN f_fractal USING (piece_id)
  JOIN f_repetition USING (piece_id) JOIN f_spectral USING (piece_id) JOIN wn USING (piece_id) JOIN pieces USING (piece_id) WHERE n >= 20)"""


def matrix(spark, sf_dir):
    return op.feature_matrix(views.notes(spark, sf_dir), views.pieces(spark, sf_dir))


def _on_notes(f):
    return lambda spark, sf_dir: rounded(f(views.notes(spark, sf_dir)))


def _sql(ctes: str, source: str, names: list[str]) -> str:
    return f"WITH {ctes} SELECT piece_id, {', '.join(R(n, n) for n in names)} FROM {source}"


QUERIES = {
    "note_view": lambda spark, sf_dir: rounded(views.notes(spark, sf_dir).select("piece_id", "seq", "pitch", "duration", "start")),
    "pitch_features": _on_notes(op.pitch_features), "interval_features": _on_notes(op.interval_features),
    "harmony_features": _on_notes(op.harmony_features), "rhythm_features": _on_notes(op.rhythm_features),
    "structural_features": _on_notes(op.structural_features), "spectral_features": _on_notes(op.spectral_features),
    "feature_matrix": lambda spark, sf_dir: rounded(matrix(spark, sf_dir)),
}
ORACLE_SQL = {
    "note_view": f"WITH {NOTES_SQL} SELECT piece_id, seq, pitch, {R('duration', 'duration')}, {R('start', 'start')} FROM notes",
    "pitch_features": _sql(f"{NOTES_SQL}, {PITCH_SQL}", "f_pitch", PITCH),
    "interval_features": _sql(f"{STEPS_SQL}, {INTERVAL_SQL}", "f_interval", INTERVAL),
    "harmony_features": _sql(f"{STEPS_SQL}, {HARMONY_SQL}", "f_harmony", HARMONY),
    "rhythm_features": _sql(f"{STEPS_SQL}, {RHYTHM_SQL}", "f_rhythm", RHYTHM),
    "structural_features": _sql(MATRIX_SQL, "matrix", STRUCTURAL), "spectral_features": _sql(f"{NOTES_SQL}, {SPECTRAL_SQL}", "f_spectral", SPECTRAL),
    "feature_matrix": f"WITH {MATRIX_SQL} SELECT piece_id, composer, era, {', '.join(R(n, n) for n in MATRIX)} FROM matrix",
}
