"""Queries of games, forms, phase space and similarity."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..operators import chaos, forms, games, layout, neighbours, warping
from ..operators import similarity as sim
from ..sources import views
from ..sources.views import MOTES_SQL, NOTES_SQL

_PAY = "(CAST([" + ", ".join(map(str, games.PAYOFF)) + "] AS DOUBLE[]))"
_GAME = NOTES_SQL + f""",
gp AS (SELECT piece_id, seq, pitch % 12 AS pc, {_PAY}[abs(pitch % 12 - lead(pitch % 12) OVER (PARTITION BY piece_id ORDER BY seq)) + 1] AS pay FROM notes),
gb AS (SELECT *, lag(pay) OVER (PARTITION BY piece_id ORDER BY seq) AS bef FROM gp WHERE pay IS NOT NULL)"""
_if = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END)"
_NE = [float(max(x, 1e-12)) for x in games.equilibrium()]
_PAIR = "bef IS NOT NULL"


def _n(f):
    return lambda spark, sf_dir: rounded(f(views.notes(spark, sf_dir)))


def _m(f):
    return lambda spark, sf_dir: rounded(f(views.motes(spark, sf_dir)))


def _warped(spark, sf_dir):
    """Every piece is a query."""
    series = warping.series_of(views.notes(spark, sf_dir))
    return warping.similar(series, series)[0]


def _pruned(spark, sf_dir):
    series = warping.series_of(views.notes(spark, sf_dir))
    return warping.similar(series, series.where("piece_id % 20 = 0"))[1]


def _vectors(spark, sf_dir):
    return views.table(spark, sf_dir, "embeddings")


QUERIES = {
    "iterated_game_payoffs": _n(games.iterated_payoffs), "minimax_score": _n(games.minimax), "tension_resolution": _n(games.tension_resolution),
    "evolutionary_stability": _n(games.evolutionary_stability), "nash_distance": _n(games.nash_distance),
    "shapley_pitch_values": _n(games.shapley), "game_theory": _n(games.analyze),
    "chords": lambda s, d: rounded(forms.chords(views.motes(s, d).withColumn("start", F.floor(F.col("start") / 2) * 2))),
    "progression_patterns": lambda s, d: rounded(
        forms.progression_patterns(forms.chords(views.notes(s, d).withColumn("start", F.floor(F.col("start") / 4) * 4)))
    ),
    "palindromes": _m(forms.palindromes), "structural_mirrors": _m(lambda n: forms.structural_mirrors(n, threshold=0.75)),
    "retrograde_motion": _m(lambda n: forms.retrograde_motion(n, 3)), "symmetry_score": _m(forms.symmetry_score),
    "phase_space_embedding": _n(chaos.embedding), "chaos": _n(chaos.analyze),
    "cosine_neighbours": lambda s, d: rounded(sim.nearest(v := _vectors(s, d), v.where("vec_id % 20 = 0"))),
    "pearson_similarity": _n(lambda n: sim.pearson_to(n, n.where("piece_id % 20 = 0"))),
    "alignment_similarity": _n(lambda n: sim.align_to(n, n.where("piece_id % 20 = 0"))),
    "lsh_search": lambda s, d: rounded(sim.lsh_search(v := _vectors(s, d), v.where("vec_id % 20 = 0"))), "normalized_series": _n(sim.normalized),
    "neighbour_search": lambda s, d: rounded(neighbours.search(v := _vectors(s, d), v.where("vec_id % 20 = 0"))),
    "neighbour_layout": lambda s, d: rounded(layout.layout(_vectors(s, d)), 3),
    "similar_tracks_by_measure": _n(
        lambda n: reduce(DataFrame.unionByName, [sim.similar_tracks_by(n, n.where("piece_id % 20 = 0"), a) for a in ("dtw", "lcs", "pearson", "cosine")])
    ),
    "histogram_neighbours": _n(lambda n: sim.similar_tracks_by(n, n.where("piece_id % 20 = 0"), "cosine")),
    "warping_search": lambda s, d: rounded(_warped(s, d)), "warping_pruning": _pruned,
    "interval_series": _n(lambda n: sim.sequence_of(n, "interval")),
}
ORACLE_SQL = {
    "iterated_game_payoffs": f"""WITH {_GAME} SELECT piece_id, {R("avg(pay)", "mean_payoff")}, {R(_if("pay > 0"), "cooperation_rate")}, {R(_if("pay < 0"), "defection_rate")},
  {R(f"CASE WHEN count(*) > 2 THEN avg(CASE WHEN (pay > 0) = (bef > 0) THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE {_PAIR}) ELSE 0 END", "tit_for_tat_score")}, {R("var_pop(pay)", "payoff_variance")} FROM gb GROUP BY piece_id""",
    "minimax_score": f"WITH {_GAME}, mw AS (SELECT piece_id, CASE WHEN count(*) OVER w = 7 THEN min(pay) OVER w END AS l FROM gp WHERE pay IS NOT NULL WINDOW w AS (PARTITION BY piece_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) SELECT piece_id, {R('coalesce((avg(l) + 1) / 2, 0)', 'minimax_score')} FROM mw GROUP BY piece_id",
    "tension_resolution": f"""WITH {_GAME}, r AS (SELECT piece_id, {_if("bef > 0 AND pay > 0")} AS cc, {_if("bef > 0 AND pay <= 0")} AS cd, {_if("bef <= 0 AND pay > 0")} AS dc, {_if("bef <= 0 AND pay <= 0")} AS dd FROM gb WHERE {_PAIR} GROUP BY piece_id)
SELECT piece_id, {R("cc", "cc_rate")}, {R("cd", "cd_rate")}, {R("dc", "dc_rate")}, {R("dd", "dd_rate")}, {R("(3 * cc + 5 * dc + dd) / 5", "pd_total_payoff")}, {R("dc", "surprise_resolution_rate")} FROM r""",
    "evolutionary_stability": f"""WITH {NOTES_SQL}, nb AS (SELECT piece_id, count(*) // 32 AS b FROM notes GROUP BY piece_id),
bl AS (SELECT DISTINCT piece_id, seq // 32 AS k FROM notes JOIN nb USING (piece_id) WHERE seq // 32 < b AND b >= 2),
ds AS (SELECT bl.piece_id, k, pc, count(pitch) / 32.0::DOUBLE AS d FROM bl CROSS JOIN (SELECT unnest(range(12)) AS pc) AS p LEFT JOIN notes AS n ON n.piece_id = bl.piece_id AND n.seq // 32 = k AND n.pitch % 12 = pc GROUP BY ALL),
ms AS (SELECT piece_id, pc, avg(d) AS m FROM ds GROUP BY ALL),
vs AS (SELECT piece_id, a AS pc, sum({_PAY}[abs(a - pc) + 1] * m) AS v FROM ms, (SELECT unnest(range(12)) AS a) AS q GROUP BY ALL),
sc AS (SELECT ds.piece_id, k, sum(abs(d - m)) / 2 AS dev, round(sum(d * v), 12) >= round(sum(v) / 12, 12) AS h FROM ds JOIN ms USING (piece_id, pc) JOIN vs USING (piece_id, pc) GROUP BY ALL),
fs AS (SELECT piece_id, greatest(0, 1 - avg(dev)) AS s, avg(CASE WHEN h THEN 1.0::DOUBLE ELSE 0 END) AS r FROM sc GROUP BY piece_id)
SELECT nb.piece_id, {R("coalesce(s, 0)", "strategy_stability")}, {R("coalesce(r, 0)", "invasion_resistance")} FROM nb LEFT JOIN fs USING (piece_id)""",
    "nash_distance": f"""WITH {NOTES_SQL}, hs AS (SELECT piece_id, pc, greatest(count(*) FILTER (WHERE pitch % 12 = pc) / (count(*) + 1e-12), 1e-12) AS h, count(*) AS n FROM notes, (SELECT unnest(range(12)) AS pc) AS p GROUP BY piece_id, pc)
SELECT piece_id, {R(f"CASE WHEN max(n) < 5 THEN 0 ELSE greatest(0, sum(h * ln(h / CAST({_NE} AS DOUBLE[])[CAST(pc + 1 AS INTEGER)]))) END", "nash_distance")} FROM hs GROUP BY piece_id""",
    "retrograde_motion": f"""WITH {MOTES_SQL}, l AS (SELECT piece_id, list(pitch ORDER BY seq) AS v FROM motes GROUP BY piece_id),
w AS (SELECT piece_id, v[i + 1:i + 3] = list_reverse(v[i + 4:i + 6]) AS h FROM (SELECT piece_id, v, unnest(range(0, len(v) - 5)) AS i FROM l) AS x) SELECT piece_id, coalesce(bool_or(h), false) AS has_retrograde FROM w GROUP BY piece_id""",
    "phase_space_embedding": f"WITH {NOTES_SQL}, e AS (SELECT piece_id, seq, CAST(pitch AS DOUBLE) AS a, CAST(lead(pitch) OVER w AS DOUBLE) AS b, CAST(lead(pitch, 2) OVER w AS DOUBLE) AS c FROM notes WINDOW w AS (PARTITION BY piece_id ORDER BY seq)) SELECT piece_id, seq, {R('a', 'x0')}, {R('b', 'x1')}, {R('c', 'x2')} FROM e WHERE c IS NOT NULL",
    "cosine_neighbours": f"""WITH p AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings AS a JOIN embeddings AS b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
s AS (SELECT query, neighbour, round(list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))), 9) AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, neighbour) AS k FROM s) SELECT query, neighbour, CAST(k AS INTEGER) AS rank, {R('score', 'score')} FROM r WHERE k <= 10""",
    "pearson_similarity": f"WITH {NOTES_SQL}, c AS (SELECT q.piece_id AS query, a.piece_id, coalesce(corr(a.pitch, q.pitch), 0) AS c FROM notes AS a JOIN notes AS q ON q.piece_id % 20 = 0 AND q.seq = a.seq AND a.piece_id <> q.piece_id GROUP BY ALL) SELECT query, piece_id, {R('c', 'r')}, {R('(c + 1) / 2', 'similarity')} FROM c",
    "histogram_neighbours": f"""WITH {NOTES_SQL}, b AS (SELECT piece_id, least(CAST(floor(pitch / (127 / 12.0::DOUBLE)) AS INTEGER), 11) AS bin, count(*) AS n FROM notes GROUP BY ALL),
s AS (SELECT piece_id, sum(n) AS notes, sqrt(sum(n * n)) AS norm FROM b GROUP BY 1),
p AS (SELECT q.piece_id AS query, a.piece_id, sum(q.n * a.n) AS dot FROM b AS q JOIN b AS a ON q.piece_id % 20 = 0 AND q.bin = a.bin AND q.piece_id <> a.piece_id GROUP BY ALL),
c AS (SELECT q.piece_id AS query, a.piece_id, round(coalesce(dot, 0) / (q.norm * a.norm), 9) AS score FROM s AS q JOIN s AS a ON q.piece_id % 20 = 0 AND q.piece_id <> a.piece_id AND a.notes >= 10
      LEFT JOIN p ON p.query = q.piece_id AND p.piece_id = a.piece_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, piece_id) AS k FROM c) SELECT 'cosine' AS algorithm, query, piece_id, CAST(k AS INTEGER) AS rank, {R('score', 'similarity')} FROM r WHERE k <= 10""",
    "normalized_series": f"WITH {NOTES_SQL} SELECT piece_id, seq, {R('coalesce((pitch - min(pitch) OVER w) / nullif(CAST(max(pitch) OVER w - min(pitch) OVER w AS DOUBLE), 0), 0)', 'value')} FROM notes WINDOW w AS (PARTITION BY piece_id)",
    "interval_series": f"WITH {NOTES_SQL}, i AS (SELECT piece_id, seq, CAST(pitch - lag(pitch) OVER (PARTITION BY piece_id ORDER BY seq) AS DOUBLE) AS v FROM notes) SELECT piece_id, seq, {R('v', 'value')} FROM i WHERE v IS NOT NULL",
}
