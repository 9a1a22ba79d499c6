"""Queries of Markov models, motifs, instrument intervals and smoothers."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..operators import chunks
from ..operators import instruments as ins
from ..operators import markov as mk
from ..operators import motifs as mo
from ..operators import repeats
from ..operators import series as se
from ..sources import views
from ..sources.views import INSTRUMENTS_SQL, MOTES_SQL, NOTES_SQL



def _model(state: str, source: str = "notes", by: str = "") -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {g}src"
    return f"""st AS (SELECT piece_id, seq, {state} AS src FROM {source}),
tr AS (SELECT piece_id, src, lead(src) OVER (PARTITION BY piece_id ORDER BY seq) AS dst FROM st),
mc AS (SELECT {g}src, dst, count(*) AS n FROM tr WHERE dst IS NOT NULL GROUP BY {g}src, dst),
model AS (SELECT *, n / CAST(sum(n) OVER ({part}) AS DOUBLE) AS p FROM mc)"""


_LEVEL = "least(greatest(CAST(trunc(duration * 2) AS INTEGER), 0), 7)"
_NAME = "CASE WHEN duration < 0.25 THEN '16th' WHEN duration < 0.5 THEN '8th' WHEN duration < 1 THEN 'quarter' WHEN duration < 2 THEN 'half' ELSE 'whole' END"


def _chunked(spark, sf_dir):
    """Interval n-grams in three chunks, the second of which fails at first; the job is resumed, merged and kept in buckets."""
    fails = [True]

    def compute(notes):
        grams = mo.interval_ngrams(notes, (3, 4, 5))
        if fails and compute.chunk == 1:
            fails.clear()
            return grams.withColumn("support", F.raise_error(F.lit("lost")).cast("bigint"))
        return grams

    compute.chunk = None
    job = chunks.ChunkedJob(views.motes(spark, sf_dir), "piece_id", compute, 3)
    for chunk in range(3):
        compute.chunk = chunk
        try:
            job.run_chunk(chunk)
        except Exception as e:  # what a scheduler would see: the chunk is left for resume()
            if "lost" not in str(e):
                raise
    compute.chunk = None
    job.resume()
    return job.keep(8)


def _era(spark, sf_dir, era):
    return views.notes(spark, sf_dir).join(views.pieces(spark, sf_dir).where(F.col("era") == era).select("piece_id"), "piece_id", "left_semi")


from ..sources.views import PIECES_SQL  # noqa: E402

_TWO = f"""{NOTES_SQL}, {PIECES_SQL},
tr AS (SELECT era, pitch % 12 AS src, lead(pitch % 12) OVER (PARTITION BY piece_id ORDER BY seq) AS dst FROM notes JOIN pieces USING (piece_id)),
mc AS (SELECT era, src, dst, count(*) AS n FROM tr WHERE dst IS NOT NULL GROUP BY ALL), md AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY era, src) AS DOUBLE) AS p FROM mc),
xy AS (SELECT src, dst, coalesce(a.p, 0) AS x, coalesce(b.p, 0) AS y FROM (SELECT * FROM md WHERE era = 'ASIA') AS a FULL JOIN (SELECT * FROM md WHERE era = 'EUROPE') AS b USING (src, dst))"""

_TRANS = INSTRUMENTS_SQL + """,
tm AS (SELECT DISTINCT piece_id, unnest([entry, exit]) AS time FROM instruments),
me AS (SELECT t.piece_id, time, event_type, velocity, abs(entry - time) < 0.5 AS e, abs(exit - time) < 0.5 AS x, entry < time AND exit > time AS c FROM tm AS t JOIN instruments AS i USING (piece_id)),
ag AS (SELECT piece_id, time, count(*) FILTER (WHERE e) AS entering, count(*) FILTER (WHERE x) AS exiting, count(*) FILTER (WHERE c) AS continuing, avg(velocity) FILTER (WHERE e) AS vi,
  coalesce(sum(velocity) FILTER (WHERE x), 0) + coalesce(sum(velocity) FILTER (WHERE c), 0) AS vh, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE e), '') AS fi, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE x), '') AS fo FROM me GROUP BY ALL),
ch AS (SELECT *, continuing + exiting AS b, continuing + entering AS a, CASE WHEN entering > 0 AND continuing + exiting > 0 THEN (vi - vh / (continuing + exiting)) / 127 ELSE 0 END AS vc FROM ag WHERE entering + exiting > 0),
trans AS (SELECT piece_id, time, entering, exiting, continuing, CASE WHEN b = 1 AND a > 1 THEN 'solo_to_tutti' WHEN b > 1 AND a = 1 THEN 'tutti_to_solo' WHEN b < a THEN 'thickening' WHEN b > a THEN 'thinning' ELSE 'voice_change' END AS kind, vc AS velocity_change,
  entering - exiting AS density_change, least(1, abs(vc) * 0.3 + least(abs(entering - exiting) * 0.2, 0.4) + CASE WHEN fi <> fo THEN 0.2 ELSE 0 END) AS impact FROM ch),
lay AS (SELECT s.piece_id, start_time, end_time, count(*) AS thickness FROM (SELECT piece_id, time AS start_time, lead(time) OVER (PARTITION BY piece_id ORDER BY time) AS end_time FROM trans) AS s JOIN instruments AS i ON i.piece_id = s.piece_id AND entry <= end_time AND exit >= start_time WHERE end_time IS NOT NULL GROUP BY ALL)"""


def _instrument_features(spark, sf_dir):
    i = views.instruments(spark, sf_dir)
    t = ins.transitions(i)
    return ins.features(i, t, ins.layers(i, t))


def _smooth(name):
    return lambda spark, sf_dir: rounded(se.run(views.notes(spark, sf_dir), name))


_XS = f"{NOTES_SQL}, xs AS (SELECT piece_id, list(CAST(pitch AS DOUBLE) ORDER BY seq) AS v, count(*) AS n FROM notes GROUP BY piece_id)"


def _weights_sql(weights) -> str:
    terms = " + ".join(f"{w!r} * x.v[greatest(1, least(n, i + {k}))]" for k, w in weights.items())
    return f"WITH {_XS} SELECT piece_id, CAST(i - 1 AS INTEGER) AS seq, {R(terms, 'smoothed')} FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM xs) AS x"


_SMOOTHED_HEAD = f"""WITH {MOTES_SQL}, {_model('pitch', 'motes', 'piece_id')}, ss AS (SELECT DISTINCT piece_id, src AS s FROM st), nn AS (SELECT piece_id, count(*) AS k FROM ss GROUP BY piece_id),
de AS (SELECT a.piece_id, a.s AS src, b.s AS dst, k, coalesce(n, 0) AS c FROM ss AS a JOIN ss AS b USING (piece_id) JOIN nn USING (piece_id) LEFT JOIN model AS m ON m.piece_id = a.piece_id AND m.src = a.s AND m.dst = b.s)
"""
_SMOOTHED_P = "CASE WHEN sum(c) OVER w > 0 THEN (c + 1) / CAST(sum(c) OVER w + k AS DOUBLE) ELSE 1.0 / k END"
#: The dense smoothed model, unrounded.
SMOOTHED_SQL = f"{_SMOOTHED_HEAD}SELECT piece_id, src, dst, {_SMOOTHED_P} AS p FROM de WINDOW w AS (PARTITION BY piece_id, src)"

QUERIES = {
    "markov_pitch_model": lambda s, d: rounded(mk.transitions(views.notes(s, d), _pc_())),
    "markov_duration_model": lambda s, d: rounded(mk.transitions(views.notes(s, d), mk.duration_level())),
    "markov_duration_names": lambda s, d: rounded(mk.transitions(views.notes(s, d), mk.duration_name(), ["piece_id"])),
    "interval_transition_matrix": lambda s, d: rounded(mk.transitions(views.notes(s, d), _pc_(), ["piece_id"])),
    "markov_transition_entropy": lambda s, d: rounded(mk.transition_entropy(mk.transitions(views.notes(s, d), _pc_(), ["piece_id"]), ["piece_id"])),
    "markov_similarity": lambda s, d: rounded(
        mk.model_similarity(mk.transitions(_era(s, d, "ASIA"), _pc_()), mk.transitions(_era(s, d, "EUROPE"), _pc_()))
    ),
    "markov_compare": lambda s, d: rounded(
        mk.compare_models(mk.transitions(_era(s, d, "ASIA"), _pc_()), mk.transitions(_era(s, d, "EUROPE"), _pc_()))
    ),
    "markov_smoothed": lambda s, d: rounded(mk.smoothed(views.motes(s, d), F.col("pitch"))),
    "markov_entropy_rate": lambda s, d: rounded(mk.entropy_rate(mk.smoothed(views.motes(s, d), F.col("pitch")))),
    "common_transitions": lambda s, d: rounded(mk.common_transitions(views.motes(s, d), F.col("pitch"))),
    "rare_transitions": lambda s, d: rounded(mk.rare_transitions(mk.common_transitions(views.motes(s, d), F.col("pitch")))),
    "predict_next_states": lambda s, d: rounded(mk.predict_next(mk.transitions(views.motes(s, d), F.col("pitch"), ["piece_id"]), 3, ["piece_id"])),
    "interval_ngrams": lambda s, d: mo.interval_ngrams(views.motes(s, d), (3, 4, 5)),
    "repeating_patterns": lambda s, d: mo.state_ngrams(views.motes(s, d)),
    "motif_mining": lambda s, d: rounded(mo.mine(views.motes(s, d), 3, 12, 2)),
    "maximal_repeats": lambda s, d: repeats.maximal_repeats(views.motes(s, d)),
    "motif_significance": lambda s, d: rounded(repeats.significance(views.motes(s, d), 3, 12, 2)), "chunked_ngrams": _chunked,
    "motif_summary": lambda s, d: rounded(mo.summary(mo.mine(views.motes(s, d), 3, 12, 2, top=None))),
    "instrument_view": lambda s, d: rounded(views.instruments(s, d)),
    "instrument_transitions": lambda s, d: rounded(ins.transitions(views.instruments(s, d))),
    "instrument_layers": lambda s, d: rounded(ins.layers(i := views.instruments(s, d), ins.transitions(i))),
    "instrument_features": lambda s, d: rounded(_instrument_features(s, d)),
    **{f"smooth_{name}": _smooth(name) for name in se.REGISTRY},
}


def _pc_():
    return mk.pitch_class()


ORACLE_SQL = {
    "maximal_repeats": f"""WITH {MOTES_SQL}, d AS (SELECT piece_id, seq, lead(pitch) OVER (PARTITION BY piece_id ORDER BY seq) - pitch AS iv FROM motes),
l AS (SELECT piece_id, list(iv ORDER BY seq) AS v FROM d WHERE iv IS NOT NULL GROUP BY piece_id),
a AS (SELECT piece_id, v, unnest(range(len(v))) AS i FROM l),
w AS (SELECT piece_id, v, i, unnest(range(3, len(v) - i + 1)) AS n FROM a),
g AS (SELECT piece_id, i, n, v[i + 1:i + n] AS p, CASE WHEN i > 0 THEN v[i] END AS bef, CASE WHEN i + n < len(v) THEN v[i + n + 1] END AS aft FROM w)
SELECT piece_id, CAST(min(i) AS INTEGER) AS first_position, CAST(n AS INTEGER) AS length, count(*) AS support FROM g GROUP BY piece_id, n, p
HAVING count(*) >= 2 AND (count(DISTINCT bef) > 1 OR count(bef) < count(*)) AND (count(DISTINCT aft) > 1 OR count(aft) < count(*))""",
    "markov_pitch_model": f"WITH {NOTES_SQL}, {_model('pitch % 12')} SELECT src, dst, n AS count, {R('p', 'p')} FROM model",
    "markov_duration_model": f"WITH {NOTES_SQL}, {_model(_LEVEL)} SELECT src, dst, n AS count, {R('p', 'p')} FROM model",
    "markov_duration_names": f"WITH {NOTES_SQL}, {_model(_NAME, by='piece_id')} SELECT piece_id, src, dst, n AS count, {R('p', 'p')} FROM model",
    "interval_transition_matrix": f"WITH {NOTES_SQL}, {_model('pitch % 12', by='piece_id')} SELECT piece_id, src, dst, n AS count, {R('p', 'p')} FROM model",
    "markov_transition_entropy": f"WITH {NOTES_SQL}, {_model('pitch % 12', by='piece_id')}, h AS (SELECT piece_id, src, -sum(p * log2(p)) AS h FROM model GROUP BY ALL) SELECT piece_id, {R('avg(h)', 'entropy')}, count(*) AS rows FROM h GROUP BY piece_id",
    "markov_similarity": f"WITH {_TWO} SELECT {R('sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))', 'similarity')} FROM xy",
    "markov_compare": f"WITH {_TWO} SELECT src, dst, {R('abs(x - y)', 'difference')} FROM xy",
    "markov_smoothed": f"{_SMOOTHED_HEAD}SELECT piece_id, src, dst, {R(_SMOOTHED_P, 'p')} FROM de WINDOW w AS (PARTITION BY piece_id, src)",
    "common_transitions": f"WITH {MOTES_SQL}, {_model('pitch', 'motes', 'piece_id')}, sh AS (SELECT piece_id, src, dst, n, n / CAST(sum(n) OVER (PARTITION BY piece_id) AS DOUBLE) AS s FROM model) SELECT piece_id, src, dst, n AS count, {R('s', 'share')}, {R('-log2(s)', 'surprise')} FROM sh WHERE n >= 2",
    "rare_transitions": f"""WITH {MOTES_SQL}, {_model('pitch', 'motes', 'piece_id')}, sh AS (SELECT piece_id, src, dst, n, n / CAST(sum(n) OVER (PARTITION BY piece_id) AS DOUBLE) AS s FROM model),
rk AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY round(-log2(s), 9) DESC, src, dst) AS r FROM sh WHERE n >= 2 AND s < 0.1) SELECT piece_id, src, dst, n AS count, {R('s', 'share')}, {R('-log2(s)', 'surprise')}, CAST(r AS INTEGER) AS rank FROM rk WHERE r <= 20""",
    "predict_next_states": f"WITH {MOTES_SQL}, {_model('pitch', 'motes', 'piece_id')}, rk AS (SELECT *, row_number() OVER (PARTITION BY piece_id, src ORDER BY p DESC, dst) AS r FROM model) SELECT piece_id, src, dst, n AS count, {R('p', 'p')}, CAST(r AS INTEGER) AS rank FROM rk WHERE r <= 3",
    "interval_ngrams": f"""WITH {MOTES_SQL}, iv AS (SELECT piece_id, seq, lead(pitch) OVER w - pitch AS v FROM motes WINDOW w AS (PARTITION BY piece_id ORDER BY seq)),
ag AS (SELECT piece_id, list(v ORDER BY seq) FILTER (WHERE v IS NOT NULL) AS vs FROM iv GROUP BY piece_id),
gr AS (SELECT piece_id, n, i, array_to_string(vs[i + 1:i + n], ',') AS pattern FROM (SELECT piece_id, vs, n, unnest(range(0, len(vs) - n + 1)) AS i FROM ag, (SELECT unnest([3, 4, 5]) AS n) AS y) AS z)
SELECT piece_id, CAST(n AS INTEGER) AS length, pattern, count(*) AS support, CAST(min(i) AS INTEGER) AS first_position FROM gr GROUP BY piece_id, n, pattern HAVING count(*) >= 2""",
    "repeating_patterns": f"""WITH {MOTES_SQL}, ag AS (SELECT piece_id, list(pitch ORDER BY seq) AS vs FROM motes GROUP BY piece_id),
gr AS (SELECT piece_id, n, array_to_string(vs[i + 1:i + n], ',') AS pattern FROM (SELECT piece_id, vs, n, unnest(range(0, len(vs) - n + 1)) AS i FROM ag, (SELECT unnest(range(3, 20)) AS n) AS y WHERE n <= len(vs) // 2) AS z)
SELECT piece_id, CAST(n AS INTEGER) AS length, pattern, count(*) AS support FROM gr GROUP BY piece_id, n, pattern HAVING count(*) >= 2""",
    "instrument_view": f"WITH {INSTRUMENTS_SQL} SELECT piece_id, event_type, {R('entry', 'entry')}, {R('exit', 'exit')}, note_count, {R('velocity', 'velocity')} FROM instruments",
    "instrument_transitions": f"WITH {_TRANS} SELECT piece_id, {R('time', 'time')}, entering, exiting, continuing, kind, {R('velocity_change', 'velocity_change')}, density_change, {R('impact', 'impact')} FROM trans",
    "instrument_layers": f"WITH {_TRANS} SELECT piece_id, {R('start_time', 'start_time')}, {R('end_time', 'end_time')}, thickness, thickness >= 4 AS is_tutti, thickness = 1 AS is_solo FROM lay",
    "instrument_features": f"""WITH {_TRANS} SELECT a.piece_id, instruments, transitions, {R('mean_impact', 'mean_impact')}, {R('max_impact', 'max_impact')}, layers, {R('mean_thickness', 'mean_thickness')}, {R('solo_share', 'solo_share')}
FROM (SELECT piece_id, count(*) AS instruments FROM instruments GROUP BY piece_id) AS a LEFT JOIN (SELECT piece_id, count(*) AS transitions, avg(impact) AS mean_impact, max(impact) AS max_impact FROM trans GROUP BY piece_id) AS b USING (piece_id)
LEFT JOIN (SELECT piece_id, count(*) AS layers, avg(thickness) AS mean_thickness, avg(CASE WHEN thickness = 1 THEN 1.0::DOUBLE ELSE 0 END) AS solo_share FROM lay GROUP BY piece_id) AS c USING (piece_id)""",
    "smooth_ema": f"""WITH RECURSIVE {NOTES_SQL}, walk AS (SELECT piece_id, seq, CAST(pitch AS DOUBLE) AS v FROM notes WHERE seq = 0
UNION ALL SELECT w.piece_id, n.seq, 0.3::DOUBLE * n.pitch + 0.7::DOUBLE * v FROM walk AS w JOIN notes AS n ON n.piece_id = w.piece_id AND n.seq = w.seq + 1) SELECT piece_id, seq, {R('v', 'smoothed')} FROM walk""",
    "smooth_double_exponential": f"""WITH RECURSIVE {NOTES_SQL}, walk AS (SELECT piece_id, seq, CAST(pitch AS DOUBLE) AS l, CAST(0 AS DOUBLE) AS t FROM notes WHERE seq = 0
UNION ALL SELECT piece_id, nseq, nl, 0.1::DOUBLE * (nl - l) + 0.9::DOUBLE * t FROM (SELECT w.piece_id, n.seq AS nseq, l, t, 0.3::DOUBLE * n.pitch + 0.7::DOUBLE * (l + t) AS nl FROM walk AS w JOIN notes AS n ON n.piece_id = w.piece_id AND n.seq = w.seq + 1) AS s)
SELECT piece_id, seq, {R('l + t', 'smoothed')} FROM walk""",
    "smooth_kalman": f"""WITH RECURSIVE {NOTES_SQL}, walk AS (SELECT piece_id, seq, CAST(pitch AS DOUBLE) AS x, CAST(1 AS DOUBLE) AS p FROM notes WHERE seq = 0
UNION ALL SELECT piece_id, nseq, x + k * (y - x), (1 - k) * q FROM (SELECT w.piece_id, n.seq AS nseq, x, p + 0.01::DOUBLE AS q, (p + 0.01::DOUBLE) / (p + 0.01::DOUBLE + 0.1::DOUBLE) AS k, n.pitch AS y FROM walk AS w JOIN notes AS n ON n.piece_id = w.piece_id AND n.seq = w.seq + 1) AS s)
SELECT piece_id, seq, {R('x', 'smoothed')} FROM walk""",
    "smooth_gaussian": _weights_sql(se.gaussian_weights()),
    "smooth_savitzky_golay": _weights_sql(se.savitzky_golay_weights()),
    "smooth_rolling_median": f"WITH {_XS} SELECT piece_id, CAST(i - 1 AS INTEGER) AS seq, {R('w[len(w) // 2 + 1]', 'smoothed')} FROM (SELECT piece_id, i, list_sort(v[greatest(1, i - 2):least(n, i + 2)]) AS w FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM xs) AS x) AS y",
    "smooth_wiener": f"""WITH {NOTES_SQL}, lo AS (SELECT piece_id, seq, pitch AS x, sum(pitch) OVER w / 5.0::DOUBLE AS m, sum(pitch * pitch) OVER w / 5.0::DOUBLE AS mm FROM notes WINDOW w AS (PARTITION BY piece_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
va AS (SELECT *, mm - m * m AS v, avg(mm - m * m) OVER (PARTITION BY piece_id) AS z FROM lo) SELECT piece_id, seq, {R('CASE WHEN v < z THEN m ELSE m + (x - m) * (1 - z / v) END', 'smoothed')} FROM va""",
}
ORACLE_SQL["chunked_ngrams"] = ORACLE_SQL["interval_ngrams"]
