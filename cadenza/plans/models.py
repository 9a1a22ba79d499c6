"""Queries of geometry, chroma, styles, suggestions and learned models."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..operators import models as mo
from ..operators import patterns as pt
from ..operators import shapes as sh
from ..sources import views
from ..sources.views import NOTES_SQL
from .features import HARMONY, INTERVAL, MATRIX_SQL, PITCH, RHYTHM, matrix

_COLUMNS = [*PITCH[:6], *INTERVAL, *HARMONY[:1], *RHYTHM]
_PHI = "((1 + sqrt(5)) / 2)"
_PCS = ", ".join(f"sum(CASE WHEN pitch % 12 = {k} THEN duration ELSE 0 END)" for k in range(12))
_CHROMA = f"{NOTES_SQL}, ch AS (SELECT piece_id, CAST(floor(start / 4) AS INTEGER) AS frame, [{_PCS}] AS e FROM notes GROUP BY 1, 2)"
_MEAN = "mn AS (SELECT piece_id, [" + ", ".join(f"avg(e[{k}])" for k in range(1, 13)) + "] AS m FROM ch GROUP BY piece_id)"
_ent = lambda e: f"list_sum(list_transform({e}, lambda x: -(x / (list_sum({e}) + 1e-10)) * log2(x / (list_sum({e}) + 1e-10) + 1e-10)))"
_STYLES = ", ".join(f"('{s}', {', '.join(f'{v}::DOUBLE' for v in p)})" for s, p in mo.STYLES.items())
_KEYS = ", ".join(f"({k}, '{name}', CAST({p} AS DOUBLE[]))" for k, (name, p) in enumerate(sh.keys()))


#: Coordinates of the embeddings.
_DIMENSIONS = 64


def _frames(s, d):
    return sh.chroma(views.notes(s, d))


def _vectors(s, d):
    v = views.table(s, d, "embeddings")
    return v.select(
        "vec_id", F.col("label").cast("string").alias("label"), *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(_DIMENSIONS)]
    )


QUERIES = {
    "pitch_circle": lambda s, d: rounded(sh.circle(views.notes(s, d))), "pitch_spiral": lambda s, d: rounded(sh.spiral(views.notes(s, d))),
    "archimedean_spiral": lambda s, d: rounded(sh.spiral(views.notes(s, d), "archimedean")),
    "spiral_pattern": lambda s, d: rounded(sh.spiral_pattern(views.notes(s, d))),
    "harmonic_entropy": lambda s, d: rounded(sh.harmonic_entropy(_frames(s, d))),
    "key_estimate": lambda s, d: rounded(sh.estimate_key(_frames(s, d))),
    "tonal_gravity": lambda s, d: rounded(sh.tonal_gravity(_frames(s, d))), "style_checks": lambda s, d: rounded(mo.check_styles(matrix(s, d))),
    "next_notes": lambda s, d: rounded(mo.suggest_next(n := views.notes(s, d), mo.markov_matrix(n))),
    "generated_notes": lambda s, d: rounded(mo.generate(s, mo.markov_matrix(views.notes(s, d)))),
    "nonrandomness": lambda s, d: rounded(pt.nonrandomness(views.notes(s, d))), "circle_shapes": lambda s, d: rounded(pt.shapes(views.motes(s, d))),
    "mandala_layers": lambda s, d: rounded(pt.mandala(views.notes(s, d))),
    "key_segments": lambda s, d: rounded(pt.key_segments(_frames(s, d))),
    "modulations": lambda s, d: rounded(pt.modulations(pt.key_segments(_frames(s, d)))),
    "chroma_cycles": lambda s, d: rounded(pt.chroma_cycles(_frames(s, d))),
    "generation_quality": lambda s, d: rounded(pt.generation_quality(views.notes(s, d))),
    "principal_components": lambda s, d: rounded(
        mo.principal_components(matrix(s, d), _COLUMNS).select("piece_id", "composer", "era", "pc1", "pc2"), 5
    ),
    "era_classification": lambda s, d: mo.classify(matrix(s, d), _COLUMNS, "era", folds=5, trees=300, depth=30),
    "vector_classification": lambda s, d: mo.classify(
        _vectors(s, d), [f"e{k}" for k in range(_DIMENSIONS)], "label", folds=5, trees=300, depth=30, id_col="vec_id"
    ),
}
ORACLE_SQL = {
    "pitch_circle": f"WITH {NOTES_SQL} SELECT piece_id, seq, {R('cos((pitch % 12) / 12.0 * 2 * pi() - pi() / 2)', 'x')}, {R('sin((pitch % 12) / 12.0 * 2 * pi() - pi() / 2)', 'y')} FROM notes",
    "pitch_spiral": f"WITH {NOTES_SQL} SELECT piece_id, seq, {R(f'0.1 * power({_PHI}, seq * 0.5 / (2 * pi())) * cos(seq * 0.5)', 'x')}, {R(f'0.1 * power({_PHI}, seq * 0.5 / (2 * pi())) * sin(seq * 0.5)', 'y')} FROM notes",
    "archimedean_spiral": f"WITH {NOTES_SQL} SELECT piece_id, seq, {R('(0.1 + 0.05 * seq * 0.3::DOUBLE) * cos(seq * 0.3::DOUBLE)', 'x')}, {R('(0.1 + 0.05 * seq * 0.3::DOUBLE) * sin(seq * 0.3::DOUBLE)', 'y')} FROM notes",
    "harmonic_entropy": f"""WITH {_CHROMA}, {_MEAN}, lo AS (SELECT piece_id, avg(h) AS a, stddev_pop(h) AS s FROM (SELECT piece_id, {_ent('e')} AS h FROM ch) AS x GROUP BY piece_id)
SELECT piece_id, {R(_ent('m'), 'global_entropy')}, {R('a', 'local_entropy_mean')}, {R('s', 'local_entropy_std')}, {R('a / 4', 'information_rate')}, {R('a / log2(12)', 'complexity_score')} FROM mn JOIN lo USING (piece_id)""",
    "key_estimate": f"""WITH {_CHROMA}, {_MEAN}, ce AS (SELECT piece_id, list_transform(m, lambda x: x - list_avg(m)) AS c FROM mn), ks AS (SELECT * FROM (VALUES {_KEYS}) AS v(k, name, p)),
sc AS (SELECT piece_id, k, name, round(list_inner_product(c, p) / sqrt(list_inner_product(c, c)), 9) AS s FROM ce, ks), r AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY s DESC, k) AS n FROM sc) SELECT piece_id, name AS key, {R('s', 'strength')} FROM r WHERE n = 1""",
    "tonal_gravity": f"""WITH {_CHROMA}, st AS (SELECT piece_id, frame, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS src FROM ch), mv AS (SELECT piece_id, src, lead(src) OVER (PARTITION BY piece_id ORDER BY frame) AS dst FROM st),
ct AS (SELECT piece_id, src, dst, count(*) AS n FROM mv WHERE dst IS NOT NULL GROUP BY ALL) SELECT piece_id, src, dst, {R('n / CAST(sum(n) OVER (PARTITION BY piece_id, src) AS DOUBLE)', 'p')} FROM ct""",
    "mandala_layers": f"""WITH {NOTES_SQL}, n AS (SELECT piece_id, count(*) AS n FROM notes GROUP BY piece_id HAVING count(*) >= 12),
l AS (SELECT piece_id, CAST(k AS INTEGER) AS layer, CAST(least(12, n - k * (n // 3)) AS INTEGER) AS c FROM n, (SELECT unnest(range(3)) AS k) AS x)
SELECT piece_id, layer, {R('(layer + 1) * 100.0 / 3', 'radius')}, c AS num_points, coalesce((SELECT CAST(min(d) AS INTEGER) FROM (SELECT unnest(range(2, 7)) AS d) AS y WHERE c % d = 0 AND d <= c / 2.0), c) AS symmetry_order FROM l""",
    "generation_quality": f"""WITH {MATRIX_SQL}, v AS (SELECT piece_id, count(DISTINCT abs(iv)) AS v FROM steps GROUP BY piece_id), q AS (SELECT piece_id, 0.3::DOUBLE * CASE WHEN pitch_entropy BETWEEN 2 AND 2.6 THEN 1 ELSE greatest(0, 1 - least(abs(pitch_entropy - 2), abs(pitch_entropy - 2.6::DOUBLE)) / 0.5::DOUBLE) END
  + least(v / 13.0::DOUBLE, 1) * 0.25::DOUBLE + CASE WHEN pitch_range BETWEEN 12 AND 36 THEN 1 ELSE greatest(0, 1 - abs(pitch_range - 24) / 24.0::DOUBLE) END * 0.45::DOUBLE AS s FROM matrix JOIN v USING (piece_id)) SELECT piece_id, {R('s', 'quality')}, s >= 0.65 AS passes FROM q""",
    "style_checks": f"""WITH {MATRIX_SQL}, sty AS (SELECT * FROM (VALUES {_STYLES}) AS v(style, p0, p1, p2, p3, p4, p5, p6)), j AS (SELECT piece_id, style, pitch_entropy BETWEEN p0 AND p1 AS a, consonance_score >= p2 AS b, step_ratio >= p3 AS c,
  (abs(pitch_entropy - (p0 + p1) / 2) + abs(repetition_index - p4) + abs(fractal_dimension - (p5 + p6) / 2)) / 3 AS dist FROM matrix, sty) SELECT piece_id, style, a AS entropy_ok, b AS consonance_ok, c AS steps_ok, a AND b AND c AS valid, {R('dist', 'distance')} FROM j""",
}
