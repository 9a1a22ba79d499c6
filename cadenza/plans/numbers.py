"""Queries of the number-theoretic measures."""

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..operators import numbers as op
from ..sources import views
from .features import STEPS_SQL

PHI = "((1 + sqrt(5)) / 2)"
_in = lambda xs: "(" + ", ".join(map(str, xs)) + ")"
_PRIMES = """
primes AS (SELECT n FROM (SELECT unnest(range(2, 12000)) AS n) AS a WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(range(2, 110)) AS d) AS b WHERE d * d <= n AND n % d = 0))"""
PREP_SQL = STEPS_SQL + """,
prep AS (SELECT *, abs(iv) AS size, max(pitch) OVER (PARTITION BY piece_id) AS top, lead(duration) OVER w AS nd, sum(pitch) OVER (PARTITION BY piece_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS tp FROM steps WINDOW w AS (PARTITION BY piece_id ORDER BY seq)),
cnt AS (SELECT piece_id, count(*) AS n FROM notes GROUP BY piece_id),
clim AS (SELECT piece_id, min(seq) FILTER (WHERE pitch = top) / CAST(count(*) AS DOUBLE) AS pos FROM prep GROUP BY piece_id)"""


def _phrases(name: str, sign: str) -> str:
    return f"""
lim AS (SELECT piece_id, quantile_cont(size, 0.75) AS l FROM prep WHERE size IS NOT NULL GROUP BY piece_id),
{name} AS (SELECT piece_id, g, count(*) AS len FROM (SELECT piece_id, sum(CASE WHEN size {sign} l THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM prep JOIN lim USING (piece_id)) AS x GROUP BY piece_id, g)"""


_SEC = "[n // 5, n // 5, n // 5, n // 5, n - 4 * (n // 5)]"
_share = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE size IS NOT NULL)"
_SIX = "greatest(1, CAST(round_even(duration * 4, 0) AS INTEGER))"
_PRIME_SHARES = f"{_share('size IN (SELECT n FROM primes)')} AS ipd, avg(CASE WHEN {_SIX} IN (SELECT n FROM primes) THEN 1.0::DOUBLE ELSE 0 END) AS dpr"

QUERIES = {
    "golden_ratio_structure": lambda spark, sf_dir: rounded(op.golden_ratio_structure(views.notes(spark, sf_dir))),
    "prime_structure": lambda spark, sf_dir: rounded(op.prime_structure(views.notes(spark, sf_dir))),
    "prime_harmonics": lambda spark, sf_dir: rounded(op.prime_harmonics(views.notes(spark, sf_dir))),
    "known_patterns": lambda spark, sf_dir: rounded(op.known_patterns(views.notes(spark, sf_dir))),
    "numeric_patterns": lambda spark, sf_dir: rounded(op.numeric_patterns(views.notes(spark, sf_dir))),
}
ORACLE_SQL = {
    "golden_ratio_structure": f"""WITH {PREP_SQL},
sec AS (SELECT piece_id, avg(CASE WHEN EXISTS (SELECT 1 FROM (SELECT unnest([{", ".join(map(str, sorted(set(op.additive(1, 1, 30)))))}]) AS f) AS y WHERE abs(x - f) <= 2) AND x >= 1 THEN 1.0::DOUBLE ELSE 0 END) AS r FROM (SELECT piece_id, unnest({_SEC}) AS x FROM cnt) AS s GROUP BY piece_id),
dur AS (SELECT piece_id, avg(CASE WHEN abs(duration / nd - {PHI}) < 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS g FROM prep WHERE nd <> 0 GROUP BY piece_id),
fib AS (SELECT piece_id, count(*) FILTER (WHERE size IN {_in(op.FIBONACCI[:19])}) AS k FROM prep GROUP BY piece_id)
SELECT piece_id, {R("pos", "climax_position_ratio")}, {R(f"abs(pos - 1 / {PHI})", "climax_golden_distance")}, abs(pos - 1 / {PHI}) < 0.05 AS climax_is_golden, {R("r", "fibonacci_section_ratio")}, {R("coalesce(g, 0)", "golden_ratio_in_durations")}, k AS fibonacci_intervals
FROM clim JOIN sec USING (piece_id) JOIN dur USING (piece_id) JOIN fib USING (piece_id)""",
    "prime_structure": f"""WITH {PREP_SQL}, {_PRIMES}, {_phrases("ph", ">")},
pp AS (SELECT piece_id, count(*) FILTER (WHERE len IN (SELECT n FROM primes)) AS k FROM ph GROUP BY piece_id),
base AS (SELECT piece_id, {_PRIME_SHARES}, count(DISTINCT size) AS u, count(*) AS t FROM prep GROUP BY piece_id)
SELECT piece_id, {R("ipd", "interval_prime_density")}, {R("dpr", "duration_prime_ratio")}, u AS unique_intervals, t AS total_notes, k AS num_prime_phrases FROM base JOIN pp USING (piece_id)""",
    "prime_harmonics": f"""WITH {PREP_SQL}
SELECT piece_id, CAST(p AS INTEGER) AS harmonic, {R("count(*) FILTER (WHERE pitch % 12 = p % 12) / (count(*) + 1e-8)", "amplitude")} FROM notes, (SELECT unnest([2, 3, 5, 7, 11, 13, 17, 19]) AS p) AS x GROUP BY piece_id, p""",
    "known_patterns": f"""WITH {PREP_SQL}, {_PRIMES}, {_phrases("ph", ">=")},
fp AS (SELECT piece_id, avg(CASE WHEN len IN {_in(op.FIBONACCI)} THEN 1.0::DOUBLE ELSE 0 END) AS r FROM ph GROUP BY piece_id),
gs AS (SELECT piece_id, coalesce(avg(1 - d / 0.15) FILTER (WHERE d < 0.15), 0) AS g FROM (SELECT piece_id, abs(CAST(s[i] AS DOUBLE) / s[i + 1] - {PHI}) AS d FROM (SELECT piece_id, {_SEC} AS s, unnest([1, 2, 3, 4]) AS i FROM cnt) AS a) AS b GROUP BY piece_id),
base AS (SELECT piece_id, {_PRIME_SHARES}, {_share(f"size IN {_in(op.FIBONACCI)}")} AS fi, {_share(f"size IN {_in(op.LUCAS)}")} AS lu, {_share(f"size IN {_in(op.PERFECT)}")} AS pe, {_share(f"size IN {_in(op.TRIANGULAR)}")} AS tr,
  avg(CASE WHEN {" OR ".join(f"abs(duration / nd - {p}.0 / {q}) / ({p}.0 / {q}) < 0.12" for p, q in op.PYTHAGOREAN)} THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE nd IS NOT NULL) AS py, avg(CASE WHEN tp IN (SELECT n FROM primes) THEN 1.0::DOUBLE ELSE 0 END) AS cp FROM prep GROUP BY piece_id)
SELECT piece_id, {R("ipd", "interval_prime_density")}, {R("dpr", "duration_prime_ratio")}, {R("pos", "climax_position_ratio")}, {R(f"abs(pos - 1 / {PHI})", "climax_golden_distance")}, {R(f"CASE WHEN abs(pos - 1 / {PHI}) < 0.05 THEN 1 ELSE 0 END", "climax_near_golden")},
  {R("fi", "fibonacci_interval_ratio")}, {R("lu", "lucas_interval_ratio")}, {R("pe", "perfect_interval_ratio")}, {R("tr", "triangular_interval_ratio")}, {R("g", "golden_section_ratio_score")}, {R("py", "pythagorean_duration_ratio")}, {R("cp", "cumulative_prime_ratio")}, {R("r", "fibonacci_phrase_ratio")}
FROM base JOIN clim USING (piece_id) JOIN fp USING (piece_id) JOIN gs USING (piece_id)""",
    "numeric_patterns": f"""WITH {PREP_SQL}, {_PRIMES},
spot AS (SELECT piece_id, n, unnest([1 / {PHI}, 1 / power({PHI}, 2), 1 - 1 / {PHI}, 1 - 1 / power({PHI}, 2)]) AS f FROM cnt),
phi AS (SELECT s.piece_id, count(DISTINCT seq) / CAST(max(n) AS DOUBLE) AS d FROM spot AS s JOIN notes AS t ON s.piece_id = t.piece_id AND abs(seq - round_even(f * (n - 1), 0)) <= least(greatest(1, CAST(floor(0.03 * n) AS INTEGER)), 32) GROUP BY s.piece_id),
zs AS (SELECT piece_id, seq, (iv - avg(iv) OVER w) / stddev_pop(iv) OVER w AS z, count(*) OVER w AS m FROM steps WHERE iv IS NOT NULL WINDOW w AS (PARTITION BY piece_id)),
ac AS (SELECT piece_id, avg(a) AS s FROM (SELECT x.piece_id, y.seq - x.seq AS lag, abs(avg(x.z * y.z)) AS a FROM zs AS x JOIN zs AS y ON x.piece_id = y.piece_id AND y.seq - x.seq BETWEEN 1 AND 11 AND y.seq - x.seq < x.m // 2 GROUP BY ALL) AS q GROUP BY piece_id),
base AS (SELECT piece_id, count(*) AS n_notes, avg(pitch) AS pm, stddev_pop(pitch) AS ps, avg(CASE WHEN tp IN (SELECT n FROM primes) THEN 1.0::DOUBLE ELSE 0 END) AS cp FROM prep GROUP BY piece_id)
SELECT piece_id, n_notes, {R("pm", "pitch_mean")}, {R("ps", "pitch_std")}, {R("cp", "prime_sum_ratio")}, {R("d", "phi_density_ratio")}, {R("coalesce(s, 0)", "interval_self_similarity")} FROM base JOIN phi USING (piece_id) LEFT JOIN ac USING (piece_id)""",
}
