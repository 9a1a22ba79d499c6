"""Queries of composition, clustering and combined features; and SQL for chords, spirals, entropy rates and what is built on them."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..operators import composition as op
from ..operators import forms, markov, patterns, series, statistics
from ..operators import models as mo
from ..operators import shapes as sh
from ..sources import views
from ..sources.views import MOTES_SQL, NOTES_SQL
from . import sequences
from .features import HARMONY, INTERVAL, MATRIX_SQL, PITCH, RHYTHM, matrix

_COLUMNS = [*PITCH[:6], *INTERVAL, *HARMONY[:1], *RHYTHM]


def _markov(s, d):
    return mo.markov_matrix(views.notes(s, d))


def _chords(s, d):
    return forms.chords(views.motes(s, d).withColumn("start", F.floor(F.col("start") / 2) * 2))


def _beauty(s, d):
    liked = matrix(s, d).withColumn("liked", F.col("pitch_entropy") * 2 + F.col("consonance_score") + F.col("piece_id") % 7)
    return statistics.beauty_weights(liked, "liked")


QUERIES = {
    "styled_pieces": lambda s, d: rounded(op.compose(s, _markov(s, d), "romantic", key="C_major")),
    "emotional_pieces": lambda s, d: rounded(op.emotional(s, _markov(s, d), "dramatic")),
    "composer_hierarchy": lambda s, d: rounded(op.hierarchy(matrix(s, d), "composer", _COLUMNS), 5),
    "feature_importance": lambda s, d: rounded(op.feature_importance(matrix(s, d), _COLUMNS, "era")),
    "kalman_forecast": lambda s, d: rounded(op.forecast(series.run(views.notes(s, d), "kalman"), 4, "smoothed")),
    "progression_complexity": lambda s, d: rounded(forms.progression_complexity(_chords(s, d))),
    "palindrome_features": lambda s, d: rounded(forms.palindrome_features(views.motes(s, d))),
    "geometric_complexity": lambda s, d: rounded(patterns.geometric_complexity(views.motes(s, d))),
    "chroma_geometry": lambda s, d: rounded(patterns.chroma_geometry(sh.chroma(views.notes(s, d)))),
    "markov_features": lambda s, d: rounded(markov.features(views.motes(s, d))),
    "beauty_weights": lambda s, d: rounded(_beauty(s, d)),
}


def _chords_sql(view, width):
    """Tables ct (chords with their keys) and cd (numerals); chords are major or minor triads of notes that start in one stretch of ``width``."""
    has = lambda k: f"bool_or((b.pc - a.pc + 12) % 12 = {k})"
    major, minor = "[0, 2, 4, 5, 7, 9, 11]", "[0, 2, 3, 5, 7, 8, 10]"
    scale = f"CASE WHEN m THEN {minor} ELSE {major} END"
    step = "((root - t + 12) % 12)"
    return f"""
cn AS (SELECT DISTINCT piece_id, floor(start / {width}) * {width} AS time, pitch % 12 AS pc FROM {view}),
cr AS (SELECT a.piece_id, a.time, a.pc AS root, {has(4)} AND {has(7)} AS maj, {has(3)} AND {has(7)} AS mnr FROM cn AS a JOIN cn AS b ON a.piece_id = b.piece_id AND a.time = b.time GROUP BY ALL),
cb AS (SELECT piece_id, time, min(root) AS root, arg_min(CASE WHEN maj THEN 'major' ELSE 'minor' END, root) AS quality FROM cr WHERE maj OR mnr GROUP BY ALL),
cp AS (SELECT *, lag(root) OVER w AS pr, lag(quality) OVER w AS pq FROM cb WINDOW w AS (PARTITION BY piece_id ORDER BY time)),
cf AS (SELECT piece_id, time, root, quality, row_number() OVER (PARTITION BY piece_id ORDER BY time) - 1 AS position FROM cp WHERE pr IS NULL OR pr <> root OR pq <> quality),
ks AS (SELECT piece_id, t, m, sum(CASE WHEN list_contains({scale}, {step}) THEN 1 ELSE 0 END + CASE {step} WHEN 7 THEN 2 WHEN 0 THEN 3 ELSE 0 END) AS score FROM cf, (SELECT unnest(range(12)) AS t) AS x, (SELECT unnest([false, true]) AS m) AS y GROUP BY ALL),
kb AS (SELECT piece_id, t, m FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY score DESC, t, m) AS k FROM ks) AS r WHERE k = 1),
ct AS (SELECT piece_id, position, time, root, quality, t, m, list_position({scale}, {step}) AS degree, {step} AS step FROM cf JOIN kb USING (piece_id)),
cd AS (SELECT *, CASE WHEN degree IS NULL OR degree = 0 THEN CAST(step AS VARCHAR) WHEN quality = 'minor' THEN lower((['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'])[degree]) ELSE (['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'])[degree] END AS numeral FROM ct)"""


_NAMED = ", ".join(f"('{run}', '{name}', {len(run.split())})" for name, run in forms.PROGRESSIONS.items())
ORACLE_SQL = {
    "chords": f"""WITH {MOTES_SQL}, {_chords_sql('motes', 2)} SELECT piece_id, CAST(position AS INTEGER) AS position, {R('time', 'time')}, CAST(root AS INTEGER) AS root, quality, numeral, CAST(t AS INTEGER) AS tonic, m AS is_minor FROM cd""",
    "progression_patterns": f"""WITH {NOTES_SQL}, {_chords_sql('notes', 4)}, pl AS (SELECT piece_id, position, upper(numeral) AS n, count(*) OVER (PARTITION BY piece_id) AS total FROM cd),
pr AS (SELECT piece_id, total, n AS a, n || ' ' || lead(n) OVER w AS b, n || ' ' || lead(n) OVER w || ' ' || lead(n, 2) OVER w AS c, n || ' ' || lead(n) OVER w || ' ' || lead(n, 2) OVER w || ' ' || lead(n, 3) OVER w AS d FROM pl WINDOW w AS (PARTITION BY piece_id ORDER BY position)),
nm AS (SELECT * FROM (VALUES {_NAMED}) AS v(run, pattern, length)), al AS (SELECT piece_id, total, unnest([b, c, d]) AS run FROM pr)
SELECT piece_id, pattern, count(*) AS hits, {R('count(*) / greatest(1.0::DOUBLE, max(total) / CAST(max(length) AS DOUBLE))', 'frequency')} FROM al JOIN nm USING (run) GROUP BY piece_id, pattern""",
    "progression_complexity": f"""WITH {MOTES_SQL}, {_chords_sql('motes', 2)}, x AS (SELECT piece_id, count(*) AS n, count(DISTINCT (root, quality)) AS u, CASE WHEN max(time) > min(time) THEN (count(*) - 1) / (max(time) - min(time)) ELSE 0 END AS rate,
  avg(CASE WHEN root <> t THEN 1.0::DOUBLE ELSE 0 END) AS other, count(DISTINCT numeral) AS d FROM cd GROUP BY piece_id HAVING count(*) >= 2)
SELECT piece_id, {R('u / CAST(n AS DOUBLE) * 0.3 + least(rate / 2, 1) * 0.2 + other * 0.3 + d / CAST(least(n, 7) AS DOUBLE) * 0.2', 'complexity')}, u AS unique_chords, {R('u / CAST(n AS DOUBLE)', 'uniqueness_ratio')}, {R('rate', 'change_rate')}, {R('other', 'non_tonic_ratio')}, {R('d / CAST(least(n, 7) AS DOUBLE)', 'roman_diversity')} FROM x""",
    "spiral_pattern": f"""WITH {NOTES_SQL}, a AS (SELECT piece_id, seq, cos((pitch % 12) / 12.0 * 2 * pi() - pi() / 2) AS x, sin((pitch % 12) / 12.0 * 2 * pi() - pi() / 2) AS y FROM notes),
c AS (SELECT piece_id, seq, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM a WINDOW w AS (PARTITION BY piece_id)), p AS (SELECT piece_id, seq, sqrt(dx * dx + dy * dy) AS r, atan2(dy, dx) AS theta FROM c),
u AS (SELECT *, CASE WHEN lag(r) OVER w IS NOT NULL THEN CASE WHEN r > lag(r) OVER w + 1e-12 THEN 1.0::DOUBLE ELSE 0 END END AS up FROM p WINDOW w AS (PARTITION BY piece_id ORDER BY seq))
SELECT piece_id, {R('avg(up)', 'increasing')}, {R('coalesce(corr(theta, CASE WHEN r > 0 THEN ln(r) ELSE 0 END), 0)', 'correlation')}, count(*) >= 10 AND avg(up) >= 0.7 AS is_spiral FROM u GROUP BY piece_id""",
    "kalman_forecast": "WITH k AS (" + sequences.ORACLE_SQL["smooth_kalman"] + ") SELECT piece_id, CAST(step AS INTEGER) AS step, smoothed FROM (SELECT piece_id, arg_max(smoothed, seq) AS smoothed FROM k GROUP BY piece_id) AS x, (SELECT unnest(range(1, 5)) AS step) AS y",
    "markov_entropy_rate": f"""WITH RECURSIVE sm AS MATERIALIZED ({sequences.SMOOTHED_SQL}), st AS (SELECT piece_id, count(DISTINCT src) AS n FROM sm GROUP BY piece_id),
v AS (SELECT piece_id, src AS s, 0 AS k, 1.0::DOUBLE / n AS v FROM (SELECT DISTINCT piece_id, src FROM sm) AS x JOIN st USING (piece_id)
UNION ALL SELECT v.piece_id, dst, k + 1, sum(v * p) FROM v JOIN sm ON v.piece_id = sm.piece_id AND s = src WHERE k < 60 GROUP BY v.piece_id, dst, k),
h AS (SELECT sm.piece_id, -sum(v * p * log2(p)) AS h FROM v JOIN sm ON v.piece_id = sm.piece_id AND s = src WHERE k = 60 GROUP BY sm.piece_id)
SELECT piece_id, {R('h', 'entropy')}, {R('CASE WHEN n > 1 THEN least(1, greatest(0, 1 - h / log2(n))) ELSE 1 END', 'predictability')} FROM h JOIN st USING (piece_id)""",
}
