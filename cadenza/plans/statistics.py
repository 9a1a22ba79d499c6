"""Queries of the cross-piece statistics."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..functions.storage import stored
from ..operators import numbers, patterns, runs
from ..operators import statistics as op
from ..sources import views
from .features import HARMONY, INTERVAL, MATRIX_SQL, PITCH, RHYTHM, matrix

COLUMNS = [*PITCH[:6], *INTERVAL, *HARMONY, *RHYTHM]
_Z = ", ".join(
    f"CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END AS z_{c}" for c in op.SIGNATURE_INPUTS
)
SIG_SQL = f"""{MATRIX_SQL},
zed AS (SELECT piece_id, composer, era, {_Z} FROM matrix),
sig AS (SELECT piece_id, composer, era, (z_pitch_range + z_pitch_std) / 2 AS sig_melodic_volatility, z_repetition_index AS sig_motif_repetition, z_consonance_score - z_dissonance_index AS sig_consonance_balance,
  (z_pitch_entropy + z_interval_entropy + z_rhythmic_entropy + z_spectral_entropy + z_fractal_dimension) / 5 AS sig_structural_complexity FROM zed)"""
_LONG = f"long AS (UNPIVOT (SELECT piece_id, composer, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in COLUMNS)} FROM matrix) ON {', '.join(COLUMNS)} INTO NAME feature VALUE value)"
_PROFILE = f"{MATRIX_SQL}, {_LONG}, prof AS (SELECT composer, feature, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.5) AS med FROM long GROUP BY ALL)"

_FINE = "(SELECT piece_id FROM notes GROUP BY 1 HAVING count(*) >= 60 AND max(start + duration) <= 70) AS fine"
_CLEAN_PROFILE = _PROFILE.replace("FROM matrix)", f"FROM matrix JOIN {_FINE} USING (piece_id))")


def _whole_run(spark, sf_dir):
    """From notes to the composers' profiles, step by step in the shared folder."""
    run = runs.pieces_run(spark, views.notes(spark, sf_dir), views.pieces(spark, sf_dir), COLUMNS, least_notes=60, most_duration=70.0)
    run.resume()
    return rounded(run.table("composers"))


def _responses(spark, sf_dir):
    labels, docs = views.table(spark, sf_dir, "labels"), views.table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id", F.col("lang").alias("condition"), F.col("quality").cast("double").alias("likability"),
        F.col("n_chars").cast("double").alias("feature")
    )


_RESP = "resp AS (SELECT doc_id, lang AS condition, CAST(quality AS DOUBLE) AS likability, CAST(n_chars AS DOUBLE) AS feature FROM labels JOIN documents USING (doc_id))"


def _aesthetic(spark, sf_dir, walk):
    """The index over the random-walk score, or over interval self-similarity, which SQL can check."""
    notes = views.notes(spark, sf_dir)
    base = numbers.numeric_patterns(notes)
    return op.aesthetic_index(
        base.join(patterns.nonrandomness(notes), "piece_id") if walk else base, third="rw_corr_z" if walk else "interval_self_similarity"
    )


from .numbers import ORACLE_SQL as _NUMBERS  # noqa: E402

_AES = _NUMBERS["numeric_patterns"]
_NUM = _AES[
    : _AES.rindex("SELECT piece_id, n_notes")
] + ", num AS (SELECT piece_id, cp AS prime_sum_ratio, d AS phi_density_ratio, coalesce(s, 0) AS interval_self_similarity FROM base JOIN phi USING (piece_id) LEFT JOIN ac USING (piece_id))"
_zc = lambda c: f"CASE WHEN stddev_pop({c}) OVER () > 1e-12 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0 END"

QUERIES = {
    "signature_scores": lambda s, d: rounded(op.signature_scores(matrix(s, d))),
    "signature_era_summary": lambda s, d: rounded(op.group_summary(op.signature_scores(matrix(s, d)), "era", op.SIGNATURES, 3)),
    "signature_composer_summary": lambda s, d: rounded(op.group_summary(op.signature_scores(matrix(s, d)), "composer", op.SIGNATURES, 5)),
    "aesthetic_index": lambda s, d: rounded(_aesthetic(s, d, True)),
    "aesthetic_index_of_similarity": lambda s, d: rounded(_aesthetic(s, d, False)),
    "whole_run": _whole_run,
    "composer_profiles": lambda s, d: rounded(op.profiles(matrix(s, d), "composer", COLUMNS)),
    "composer_distances": lambda s, d: rounded(op.profile_distances(op.profiles(matrix(s, d), "composer", COLUMNS), "composer")),
    "closest_composer": lambda s, d: rounded(op.closest_group(m := stored(matrix(s, d)), op.profiles(m, "composer", COLUMNS), "composer", COLUMNS)),
    "anova_by_era": lambda s, d: rounded(op.anova_of(matrix(s, d), "era", ("pitch_entropy", "mean_interval"))),
    "t_test_eras": lambda s, d: rounded(op.t_test(matrix(s, d), "era", "pitch_entropy", "ASIA", "EUROPE")),
    "t_test_consonance": lambda s, d: rounded(op.one_sample_t(matrix(s, d), "consonance_score", 0.5)),
    "preference_correlation": lambda s, d: rounded(op.correlation(_responses(s, d), "likability", "feature")),
    "experiment_summary": lambda s, d: rounded(op.group_summary(_responses(s, d), "condition", ("likability",), 1)),
    "experiment_anova": lambda s, d: rounded(op.anova(_responses(s, d), "condition", "likability")),
    "kl_of_eras": lambda s, d: rounded(
        op.kl_divergence((m := stored(matrix(s, d))).where("era = 'ASIA'"), m.where("era = 'EUROPE'"), "pitch_mean"), 5
    ),
    "impact_score": lambda s, d: rounded(op.impact_score(matrix(s, d))),
}


def _summary(source: str, by: str, columns, least: int) -> str:
    parts = ", ".join(f"{R(f'avg({c})', c + '_mean')}, {R(f'stddev_samp({c})', c + '_std')}, count({c}) AS {c}_count" for c in columns)
    return f"SELECT {by}, count(*) AS n_pieces, {parts} FROM {source} GROUP BY {by} HAVING count(*) >= {least}"


def _anova_sql(source: str, by: str, column: str) -> str:
    return f"""SELECT '{column}' AS feature, {R("k - 1", "df_between")}, {R("n - k", "df_within")}, {R("((nmm - nm * nm / n) / (k - 1)) / (w / (n - k))", "f_statistic")}
FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k, sum(n * m) AS nm, sum(n * m * m) AS nmm, sum(n * v) AS w FROM (SELECT {by}, CAST(count(*) AS DOUBLE) AS n, avg({column}) AS m, var_pop({column}) AS v FROM {source} GROUP BY {by} HAVING count(*) >= 2) AS g) AS t"""


ORACLE_SQL = {
    "signature_scores": f"WITH {SIG_SQL} SELECT piece_id, composer, era, {', '.join(R(c, c) for c in op.SIGNATURES)} FROM sig",
    "signature_era_summary": f"WITH {SIG_SQL} {_summary('sig', 'era', op.SIGNATURES, 3)}",
    "signature_composer_summary": f"WITH {SIG_SQL} {_summary('sig', 'composer', op.SIGNATURES, 5)}",
    "aesthetic_index_of_similarity": f"""{_NUM}, raw AS (SELECT piece_id, 0.25 * {_zc("prime_sum_ratio")} + 0.25 * {_zc("phi_density_ratio")} + 0.5 * {_zc("interval_self_similarity")} AS r FROM num)
SELECT piece_id, {R("r", "aesthetic_z_raw")}, {R("(r - min(r) OVER ()) / (max(r) OVER () - min(r) OVER ())", "aesthetic_index")} FROM raw""",
    "whole_run": f"WITH {_CLEAN_PROFILE} SELECT composer, feature, {R('m', 'mean')}, {R('s', 'std')}, {R('lo', 'min')}, {R('hi', 'max')}, {R('med', 'median')} FROM prof",
    "composer_profiles": f"WITH {_PROFILE} SELECT composer, feature, {R('m', 'mean')}, {R('s', 'std')}, {R('lo', 'min')}, {R('hi', 'max')}, {R('med', 'median')} FROM prof",
    "composer_distances": f"WITH {_PROFILE} SELECT x.composer AS a, y.composer AS b, {R('avg(least(abs(x.m - y.m) / ((x.s + y.s) / 2 + 1e-8), 10))', 'distance')} FROM prof AS x JOIN prof AS y ON x.feature = y.feature AND x.composer < y.composer GROUP BY ALL",
    "closest_composer": f"""WITH {_PROFILE}, sc AS (SELECT piece_id, p.composer, round(avg(abs(value - m) / s), 9) AS score FROM long AS l JOIN prof AS p ON l.feature = p.feature AND p.s > 1e-9 GROUP BY ALL)
SELECT piece_id, composer AS closest, {R('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY score, composer) AS k FROM sc) AS q WHERE k = 1""",
    "anova_by_era": f"WITH {MATRIX_SQL} {_anova_sql('matrix', 'era', 'pitch_entropy')} UNION ALL {_anova_sql('matrix', 'era', 'mean_interval')}",
    "t_test_eras": f"""WITH {MATRIX_SQL}, g AS (SELECT count(*) FILTER (WHERE era = 'ASIA') AS a, count(*) FILTER (WHERE era = 'EUROPE') AS b, avg(pitch_entropy) FILTER (WHERE era = 'ASIA') AS ma, avg(pitch_entropy) FILTER (WHERE era = 'EUROPE') AS mb, var_samp(pitch_entropy) FILTER (WHERE era = 'ASIA') AS va, var_samp(pitch_entropy) FILTER (WHERE era = 'EUROPE') AS vb FROM matrix)
SELECT 'pitch_entropy' AS feature, {R('a + b - 2', 'df')}, {R('(ma - mb) / sqrt(((a - 1) * va + (b - 1) * vb) / (a + b - 2) * (1.0::DOUBLE / a + 1.0::DOUBLE / b))', 't_statistic')} FROM g""",
    "t_test_consonance": f"WITH {MATRIX_SQL} SELECT {R('count(*)', 'n')}, {R('(avg(consonance_score) - 0.5) / (stddev_samp(consonance_score) / sqrt(count(*)))', 't_statistic')} FROM matrix",
    "preference_correlation": f"WITH {_RESP} SELECT {R('corr(likability, feature)', 'r')}, count(*) AS n FROM resp",
    "experiment_summary": f"WITH {_RESP} {_summary('resp', 'condition', ('likability',), 1)}",
    "experiment_anova": f"WITH {_RESP} {_anova_sql('resp', 'condition', 'likability')}",
    "kl_of_eras": f"""WITH {MATRIX_SQL}, bd AS (SELECT min(pitch_mean) AS lo, max(pitch_mean) AS hi FROM matrix WHERE era = 'ASIA'),
hs AS (SELECT era, CASE WHEN pitch_mean = hi THEN 19 ELSE CAST(floor((pitch_mean - lo) / ((hi - lo) / 20)) AS INTEGER) END AS b, (hi - lo) / 20 AS w FROM matrix, bd WHERE pitch_mean >= lo AND pitch_mean <= hi AND era IN ('ASIA', 'EUROPE')),
de AS (SELECT era, b, count(*) / CAST(sum(count(*)) OVER (PARTITION BY era) AS DOUBLE) / max(w) AS d FROM hs GROUP BY era, b),
xy AS (SELECT k, coalesce(p.d, 0) + 1e-8 AS x, coalesce(q.d, 0) + 1e-8 AS y FROM (SELECT unnest(range(20)) AS k) AS ks LEFT JOIN (SELECT * FROM de WHERE era = 'ASIA') AS p ON p.b = k LEFT JOIN (SELECT * FROM de WHERE era = 'EUROPE') AS q ON q.b = k)
SELECT {R('sum(x * ln(x / y) - x + y)', 'kl', 5)} FROM xy""",
    "impact_score": f"""WITH {MATRIX_SQL} SELECT piece_id, {R("greatest(0, least(1, 0.35 * CASE WHEN pitch_entropy BETWEEN 2 AND 2.8 THEN 1 ELSE greatest(0, 1 - least(abs(pitch_entropy - 2), abs(pitch_entropy - 2.8))) END + 0.25 * (1 - abs(consonance_score - 0.65)) + 0.2 * (1 - abs(repetition_index - 0.4)) + 0.2 * (1 - abs(fractal_dimension - 1.5))))", "impact")} FROM matrix""",
}
