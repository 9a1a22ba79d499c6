"""Queries of reports, keys and scales, colours, higher-order models and matrices as rows."""

import math

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..operators import drawings, experiment, features, grids, instruments, markov
from ..operators import reports as op
from ..operators import shapes
from ..operators import similarity as sim
from ..sources import files, views
from ..sources.views import MOTES_SQL, NOTES_SQL, PIECES_SQL
from .features import MATRIX_SQL, REPETITION_SQL, matrix
from .sequences import _TRANS

_CONS = "(CAST([" + ", ".join(str(c) for c in features.CONSONANCE) + "] AS DOUBLE[]))"
_FIB = "(" + ", ".join(map(str, op.FIBONACCI)) + ")"
_STEPS = f"{NOTES_SQL}, st AS (SELECT *, abs(pitch - lag(pitch) OVER (PARTITION BY piece_id ORDER BY seq)) AS iv FROM notes)"
_TENSION = "tc AS (SELECT piece_id, (seq - 1) // 8 AS block, avg(iv) / 12 AS tension FROM st WHERE iv IS NOT NULL GROUP BY ALL)"
_share = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END)"


def _experiment(spark, sf_dir):
    """An experiment made of customers, documents and labels."""
    customer, docs, labels = (views.table(spark, sf_dir, t) for t in ("customer", "documents", "labels"))
    participants = customer.selectExpr(
        "concat('P', c_custkey) AS participant_id", "concat(c_nationkey % 5 * 10 + 18, '-', c_nationkey % 5 * 10 + 27) AS age_group", "c_nationkey % 20 - 1 AS music_training_years",
        "c_mktsegment = 'BUILDING' AS is_musician",
    )
    condition = "CASE WHEN n_chars % 50 = 0 THEN 'other' WHEN n_chars % 3 = 0 THEN 'original' WHEN n_chars % 3 = 1 THEN 'generated' ELSE 'baseline' END"
    stimuli = docs.selectExpr("concat('S', doc_id) AS stimulus_id", f"{condition} AS condition", "source AS style", "concat(source, '/', doc_id, '.mid') AS filepath")
    responses = labels.join(docs.select("doc_id", "n_chars"), "doc_id").selectExpr(
        "concat('P', doc_id % 1600) AS participant_id", "concat('S', doc_id) AS stimulus_id", f"CASE WHEN toxic = 1 THEN 'baseline' ELSE {condition} END AS condition",
        "quality * 4.0D + 1 AS likability", "CAST(n_chars % 7 + 1 AS DOUBLE) AS beauty", "1.0D - toxic AS valence", "CAST(n_chars % 5 AS DOUBLE) AS arousal",
        "'Baroque' AS perceived_era", "CASE WHEN n_chars % 4 = 0 THEN 'human' WHEN n_chars % 11 = 0 THEN 'someone' ELSE 'computer' END AS perceived_origin",
    )
    return participants, stimuli, responses


def _rated(spark, sf_dir):
    participants, _, responses = _experiment(spark, sf_dir)
    return rounded(experiment.ratings(participants, responses))


_CONDITION = "CASE WHEN n_chars % 50 = 0 THEN 'other' WHEN n_chars % 3 = 0 THEN 'original' WHEN n_chars % 3 = 1 THEN 'generated' ELSE 'baseline' END"
_EXPERIMENT = f"""people AS (SELECT 'P' || c_custkey AS participant_id, c_nationkey % 20 - 1 AS years, c_mktsegment = 'BUILDING' AS is_musician FROM customer),
stimuli AS (SELECT 'S' || doc_id AS stimulus_id, {_CONDITION} AS condition FROM documents),
answers AS (SELECT 'P' || doc_id % 1600 AS participant_id, 'S' || doc_id AS stimulus_id, CASE WHEN toxic = 1 THEN 'baseline' ELSE {_CONDITION} END AS condition, quality * 4.0::DOUBLE + 1 AS likability,
  CAST(n_chars % 7 + 1 AS DOUBLE) AS beauty, 1.0::DOUBLE - toxic AS valence, CAST(n_chars % 5 AS DOUBLE) AS arousal,
  CASE WHEN n_chars % 4 = 0 THEN 'human' WHEN n_chars % 11 = 0 THEN 'someone' ELSE 'computer' END AS origin FROM labels JOIN documents USING (doc_id))"""


def _interpreted(name):
    feature, low, high, a, b, levels = op.MEASURES[name]
    value = f"least(greatest(({feature} - {low}) / ({high} - {low}), 0), 1)"
    return f"SELECT piece_id, '{name}' AS measure, {R(value, 'value')}, CASE WHEN {value} < {a} THEN '{levels[0]}' WHEN {value} < {b} THEN '{levels[1]}' ELSE '{levels[2]}' END AS level FROM matrix"


def _confidences():
    own = "CASE WHEN era IN (" + ", ".join(f"'{e}'" for e in op.ERAS) + ") THEN 0.85 ELSE 0.4 END"
    each = [
        f"SELECT piece_id, '{e}' AS era, {R(f'CASE WHEN era = {chr(39)}{e}{chr(39)} THEN {own} ELSE (1 - {own}) / 3 END', 'confidence')} FROM named" for e in op.ERAS
    ]
    return f"WITH {PIECES_SQL}, named AS (SELECT piece_id, {_ERA_SQL} AS era FROM pieces) " + " UNION ALL ".join(each)


#: Pieces have regions for eras; a report's eras are read from them by place.
_ERA_OF = {"AFRICA": "Baroque", "AMERICA": "Classical", "ASIA": "Romantic", "EUROPE": "Late Romantic"}
_ERA_SQL = "CASE era " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ERA_OF.items()) + " END"


def _era():
    names = F.create_map(*[F.lit(x) for pair in _ERA_OF.items() for x in pair])
    return names[F.col("era")]


def _model(s, d):
    return markov.transitions(views.notes(s, d), markov.pitch_class())


_MODEL_SQL = f"""{NOTES_SQL}, mv AS (SELECT pitch % 12 AS src, lead(pitch % 12) OVER (PARTITION BY piece_id ORDER BY seq) AS dst FROM notes),
mc AS (SELECT src, dst, count(*) AS c FROM mv WHERE dst IS NOT NULL GROUP BY ALL), mp AS (SELECT src, dst, c / sum(c) OVER (PARTITION BY src) AS p FROM mc)"""
_COLOURS = [[op._rgb(c)[k] for c in op.PALETTE] for k in range(3)]
_blend = lambda k, name: f"CAST(trunc(CAST({_COLOURS[k]} AS INTEGER[])[lo + 1] + (CAST({_COLOURS[k]} AS INTEGER[])[least(lo + 1, 4) + 1] - CAST({_COLOURS[k]} AS INTEGER[])[lo + 1]) * (place - lo)) AS INTEGER) AS {name}"

def _listing(s, d):
    """A catalogue made of the parts: every fourth is no MIDI file."""
    names = F.array(*[F.lit(n) for n in ("Johann Sebastian Bach", " Franz Liszt", "Nobody")])
    name = F.when(F.col("p_partkey") % 4 == 3, F.concat("p_name", F.lit(".txt"))).otherwise(F.concat("p_name", F.lit(".midi")))
    return views.table(s, d, "part").select(
        name.alias("midi_filename"), F.get(names, (F.col("p_partkey") % 3).cast("int")).alias("canonical_composer"),
        F.col("p_size").cast("int").alias("year"), F.lit(1.5).alias("duration")
    )


QUERIES = {
    "sequence_impact": lambda s, d: rounded(op.impact(views.notes(s, d))),
    "tension_curve": lambda s, d: rounded(op.tension_curve(views.notes(s, d))),
    "impact_segments": lambda s, d: rounded(op.impact_segments(views.notes(s, d))),
    "interpretations": lambda s, d: rounded(op.interpretations(matrix(s, d))),
    "track_report": lambda s, d: op.track_report(matrix(s, d)),
    "era_confidences": lambda s, d: rounded(op.era_confidences(views.pieces(s, d), _era())),
    "diatonic_shares": lambda s, d: rounded(op.diatonic_shares(views.notes(s, d))),
    "diatonic_boost": lambda s, d: rounded(op.diatonic_boost(_model(s, d))),
    "palette_colours": lambda s, d: rounded(op.palette_colours(sim.normalized(views.notes(s, d)))),
    "instrument_impacts": lambda s, d: rounded(op.instrument_impacts(instruments.transitions(views.instruments(s, d)))),
    "instrument_families": lambda s, d: s.range(-1, 130).select(F.col("id").alias("program"), op.instrument_family(F.col("id")).alias("family")),
    "self_similarity_matrix": lambda s, d: rounded(features.self_similarity(views.notes(s, d))),
    "markov_second_order": lambda s, d: rounded(markov.higher_order(views.motes(s, d), F.col("pitch"), 2)),
    "markov_third_order": lambda s, d: rounded(markov.higher_order(views.motes(s, d), F.col("pitch"), 3)),
    "similar_tracks": lambda s, d: rounded(sim.best_tracks(sim.pearson_to(n := views.notes(s, d), n.where("piece_id % 20 = 0"), top=10), 10)),
    "emotion_cells": lambda s, d: rounded(grids.emotion_cells(views.notes(s, d))),
    "spectrogram_cells": lambda s, d: rounded(grids.spectrogram_cells(views.notes(s, d))),
    "smoothed_bars": lambda s, d: rounded(grids.smoothed_bars(views.notes(s, d))),
    "experiment_violations": lambda s, d: experiment.violations(*_experiment(s, d)), "experiment_ratings": _rated,
    "golden_arc": lambda s, d: rounded(drawings.golden_arc(views.notes(s, d)), 5),
    "spectral_columns": lambda s, d: rounded(drawings.spectral_columns(views.notes(s, d))),
    "waveform_samples": lambda s, d: rounded(drawings.waveform(views.notes(s, d)), 5),
    "fractal_segments": lambda s, d: rounded(drawings.fractal_segments(views.notes(s, d)), 5),
    "json_documents": lambda s, d: rounded(
        files.from_documents(
            files.to_documents(m := matrix(s, d).select("piece_id", "composer", "pitch_mean", "total_notes"), "piece_id"), "piece_id",
            "composer string, pitch_mean double, total_notes double"
        )
    ),
    "catalogue_metadata": lambda s, d: files.catalogue_metadata(_listing(s, d)).select(
        "file_path", "composer", "era", "composition_year", "instrumentation", "quality_flag"
    ),
    "track_series": lambda s, d: rounded(sim.resolve_series(s, "track", matrix(s, d).where("piece_id = 3"), "pitch_entropy")),
    "frequency_bins": lambda s, d: rounded(s.createDataFrame(list(enumerate(shapes.bin_frequencies())), "bin int, hertz double")),
    "bins_to_chroma": lambda s, d: rounded(
        shapes.fold_bins(
            views.notes(s, d).groupBy(
                (F.col("piece_id") * 1000 + F.floor(F.col("start") / 4)).alias("frame"), (F.col("pitch") - 24).alias("bin")
            ).agg(F.sum("duration").alias("magnitude"))
        )
    ),
}
ORACLE_SQL = {
    "sequence_impact": f"""WITH {_STEPS}, {_TENSION}, r AS (SELECT piece_id, {_share(f'iv IN {_FIB} OR iv % 12 IN {_FIB}')} FILTER (WHERE iv IS NOT NULL) AS f, avg({_CONS}[CAST(iv % 12 AS INTEGER) + 1]) AS c,
  arg_max(start + duration, seq) - min(start) AS total, arg_min(start, [-pitch, seq]) - min(start) AS climax FROM st GROUP BY piece_id HAVING count(*) > 1),
g AS (SELECT piece_id, f, c, CASE WHEN total > 0 THEN abs(climax / total - 2 / (1 + sqrt(5))) ELSE 1 END AS g, t FROM r JOIN (SELECT piece_id, max(tension) AS t FROM tc GROUP BY 1) AS x USING (piece_id))
SELECT piece_id, {R('greatest(0, least(1, 0.25 * f + 0.25 * c + 0.25 * greatest(0, 1 - g * 3) + 0.25 * (1 - abs(c - 0.65) * 2)))', 'impact_score')}, {R('f', 'fibonacci_ratio')}, {R('c', 'mean_consonance')}, {R('g', 'golden_climax_distance')}, {R('t', 'peak_tension')},
CASE WHEN f > 0.4 AND g < 0.1 THEN 'mathematically_sublime' WHEN c > 0.75 AND t < 0.4 THEN 'serene_contemplative' WHEN t > 0.7 THEN 'dramatic_passionate' WHEN c < 0.4 THEN 'dark_dissonant' WHEN f > 0.3 THEN 'naturally_flowing' ELSE 'balanced_classical' END AS profile FROM g""",
    "tension_curve": f"WITH {_STEPS}, {_TENSION} SELECT piece_id, CAST(block AS BIGINT) AS block, {R('tension', 'tension')} FROM tc",
    "impact_segments": f"""WITH {_STEPS}, z AS (SELECT *, greatest(1, count(*) OVER p // 4) AS k, min(start) OVER p AS f, max(start + duration) OVER p - min(start) OVER p AS t FROM st WINDOW p AS (PARTITION BY piece_id)),
y AS (SELECT *, seq // k AS segment, CASE WHEN seq % k <> 0 THEN iv END AS i FROM z)
SELECT piece_id, CAST(segment AS BIGINT) AS segment, {R('(min(start) - any_value(f)) / greatest(any_value(t), 1)', 'position')}, {R('avg(i) / 12', 'tension')}, {R(f'avg({_CONS}[CAST(i % 12 AS INTEGER) + 1])', 'consonance')},
{R(f"{_share(f'i IN {_FIB}')} FILTER (WHERE i IS NOT NULL)", 'fibonacci_ratio')}, count(*) AS notes FROM y GROUP BY piece_id, segment HAVING count(*) > 1""",
    "interpretations": f"WITH {MATRIX_SQL} " + " UNION ALL ".join(_interpreted(m) for m in op.MEASURES),
    "track_report": f"WITH {MATRIX_SQL}, i AS (" + " UNION ALL ".join(_interpreted(m) for m in op.MEASURES) + """), l AS (SELECT piece_id, string_agg('"' || measure || '":"' || level || '"', ',' ORDER BY measure) AS x FROM i GROUP BY piece_id)
SELECT piece_id, '{"composer":"' || composer || '","era":"' || era || '","levels":{' || x || '}}' AS report FROM matrix JOIN l USING (piece_id)""",
    "era_confidences": _confidences(),
    "diatonic_shares": f"WITH {NOTES_SQL} " + " UNION ALL ".join(
        f"SELECT piece_id, '{k}' AS key, {R(_share(f'pitch % 12 IN {v}'), 'share')}, arg_max(pitch, seq) % 12 = {v[0]} AS ends_on_tonic FROM notes GROUP BY piece_id" for k,
        v in op.SCALES.items()
    ),
    "diatonic_boost": f"WITH {_MODEL_SQL}, b AS (SELECT src, dst, p * CASE WHEN dst IN {op.SCALES['C_major']} THEN 1.5::DOUBLE ELSE 1 END AS b FROM mp) SELECT src, dst, {R('b / sum(b) OVER (PARTITION BY src)', 'p')} FROM b",
    "palette_colours": f"""WITH {NOTES_SQL}, v AS (SELECT piece_id, seq, coalesce((pitch - min(pitch) OVER w) / nullif(CAST(max(pitch) OVER w - min(pitch) OVER w AS DOUBLE), 0), 0) * 4 AS place FROM notes WINDOW w AS (PARTITION BY piece_id)),
q AS (SELECT *, CAST(least(floor(place), 4) AS INTEGER) AS lo FROM v) SELECT piece_id, seq, {R('place', 'weight')}, {_blend(0, 'red')}, {_blend(1, 'green')}, {_blend(2, 'blue')} FROM q""",
    "instrument_impacts": f"""WITH {_TRANS} SELECT piece_id, {R('time', 'time')}, CASE WHEN entering > 0 AND exiting = 0 THEN 'entrance' WHEN exiting > 0 AND entering = 0 THEN 'exit' ELSE 'transition' END AS impact_type,
CASE WHEN kind = 'solo_to_tutti' THEN 'solo to full ensemble' WHEN kind = 'tutti_to_solo' THEN 'full ensemble to solo' WHEN entering > 0 AND exiting = 0 THEN 'new instruments' WHEN exiting > 0 AND entering = 0 THEN 'instruments leave' ELSE 'change' END AS description,
array_to_string(list_filter([CASE WHEN impact > 0.7 THEN 'high impact' END, CASE kind WHEN 'solo_to_tutti' THEN 'building' WHEN 'tutti_to_solo' THEN 'intimate' END, CASE WHEN velocity_change > 0.2 THEN 'louder' WHEN velocity_change < -0.2 THEN 'softer' END], lambda x: x IS NOT NULL), ',') AS factors FROM trans""",
    "instrument_families": """SELECT program, coalesce((['piano', 'chromatic_percussion', 'organ', 'guitar', 'bass', 'strings', 'ensemble', 'brass', 'reed', 'pipe', 'synth_lead', 'synth_pad', 'synth_effects', 'ethnic', 'percussive', 'sound_effects'])[CASE WHEN program BETWEEN 0 AND 127 THEN program // 8 + 1 END], 'unknown') AS family
FROM (SELECT unnest(range(-1, 130)) AS program) AS p""",
    "self_similarity_matrix": f"""WITH {NOTES_SQL}, {REPETITION_SQL.replace('y.i >= x.i + 5', 'y.i >= x.i').replace('b.i >= a.i + 5', 'b.i >= a.i')}
SELECT a.piece_id, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, {R('coalesce(d, 0) / (a.l * b.l)', 'similarity')} FROM wl AS a JOIN wl AS b ON a.piece_id = b.piece_id AND b.i >= a.i LEFT JOIN wp ON wp.piece_id = a.piece_id AND wp.i = a.i AND wp.j = b.i""",
    **{
        name: f"""WITH {MOTES_SQL}, l AS (SELECT piece_id, list(pitch ORDER BY seq) AS v FROM motes GROUP BY piece_id),
g AS (SELECT piece_id, i, array_to_string(v[i:i + {k}], ',') AS src, array_to_string(v[i + 1:i + 1 + {k}], ',') AS dst, len(v) - {k} AS m FROM (SELECT piece_id, v, unnest(range(1, len(v) - {k} + 1)) AS i FROM l) AS x),
n AS (SELECT piece_id, count(DISTINCT src) AS states FROM g GROUP BY piece_id), c AS (SELECT piece_id, src, dst, count(*) AS c FROM g WHERE i < m GROUP BY ALL)
SELECT piece_id, src, dst, c AS count, {R('(c + 1) / (CAST(sum(c) OVER (PARTITION BY piece_id, src) AS DOUBLE) + states)', 'p')}, {R('1 / (CAST(sum(c) OVER (PARTITION BY piece_id, src) AS DOUBLE) + states)', 'p_unseen')} FROM c JOIN n USING (piece_id)"""
        for name, k in (("markov_second_order", 2), ("markov_third_order", 3))
    },
    "similar_tracks": f"""WITH {NOTES_SQL}, c AS (SELECT q.piece_id AS query, a.piece_id, (coalesce(corr(a.pitch, q.pitch), 0) + 1) / 2 AS s FROM notes AS a JOIN notes AS q ON q.piece_id % 20 = 0 AND q.seq = a.seq AND a.piece_id <> q.piece_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, piece_id) AS k FROM c) SELECT query, piece_id, CAST(k AS INTEGER) AS rank, {R('s', 'similarity')} FROM r WHERE k <= 10""",
    "emotion_cells": f"""WITH {NOTES_SQL}, p AS (SELECT piece_id, duration, CAST(11 - pitch % 12 AS INTEGER) AS row, CAST(floor(seq / CAST(count(*) OVER w AS DOUBLE) * least(50, count(*) OVER w)) AS INTEGER) AS col FROM notes WINDOW w AS (PARTITION BY piece_id)),
c AS (SELECT piece_id, row, col, sum(duration * 0.5::DOUBLE + 64.0::DOUBLE / 127 * 0.5::DOUBLE) AS v FROM p GROUP BY ALL) SELECT piece_id, row, col, {R('v / max(v) OVER (PARTITION BY piece_id)', 'value')} FROM c""",
    "spectrogram_cells": f"""WITH {NOTES_SQL}, g AS (SELECT piece_id, count(*) AS n, arg_max(start + duration, seq) AS total FROM notes GROUP BY piece_id),
c AS (SELECT piece_id, CAST(pitch % 12 AS INTEGER) AS pc, CAST(floor(start / total * (least(100, n) - 1)) AS INTEGER) AS frame, sum(64.0::DOUBLE / 127 * (duration / total * n)) AS v FROM notes JOIN g USING (piece_id) GROUP BY ALL)
SELECT piece_id, pc, frame, {R('v / max(v) OVER (PARTITION BY piece_id)', 'value')} FROM c""",
    "smoothed_bars": f"""WITH RECURSIVE {NOTES_SQL}, k AS (SELECT piece_id, seq, CAST(pitch AS DOUBLE) AS x, CAST(1 AS DOUBLE) AS p FROM notes WHERE seq = 0
UNION ALL SELECT n.piece_id, n.seq, x + (p + 0.02) / (p + 0.02 + 0.08) * (pitch - x), (1 - (p + 0.02) / (p + 0.02 + 0.08)) * (p + 0.02) FROM k JOIN notes AS n ON n.piece_id = k.piece_id AND n.seq = k.seq + 1),
l AS (SELECT piece_id, seq, coalesce((x - min(x) OVER w) / nullif(max(x) OVER w - min(x) OVER w, 0), 0.5) AS level FROM k WINDOW w AS (PARTITION BY piece_id)),
b AS (SELECT piece_id, seq, count(*) OVER (PARTITION BY piece_id) AS n, coalesce(least(1, abs(pitch - lag(pitch) OVER (PARTITION BY piece_id ORDER BY seq)) / 12.0::DOUBLE), 0.5) AS speed FROM notes)
SELECT piece_id, seq, {R('seq / CAST(n - 1 AS DOUBLE) * 1199', 'x')}, {R('level', 'level')}, {R('(1 - level) * 800 * 0.8::DOUBLE + 80', 'middle')}, {R('40 + 120 * speed', 'size')} FROM b JOIN l USING (piece_id, seq) WHERE n > 1""",
    "experiment_violations": f"""WITH {_EXPERIMENT},
bad AS (SELECT a.*, p.participant_id AS p, s.condition AS c FROM answers AS a LEFT JOIN people AS p USING (participant_id) LEFT JOIN stimuli AS s USING (stimulus_id))
SELECT 'participants' AS "table", 'unique id' AS rule, count(*) - count(DISTINCT participant_id) AS n FROM people UNION ALL SELECT 'stimuli', 'unique id', count(*) - count(DISTINCT stimulus_id) FROM stimuli
UNION ALL SELECT 'participants', 'training not negative', count(*) FILTER (years < 0) FROM people UNION ALL SELECT 'participants', 'musician known', 0 UNION ALL
SELECT 'stimuli', 'known condition', count(*) FILTER (condition = 'other') FROM stimuli UNION ALL SELECT 'stimuli', 'has a file', 0 UNION ALL
SELECT 'responses', 'known participant', count(*) FILTER (p IS NULL) FROM bad UNION ALL SELECT 'responses', 'known stimulus', count(*) FILTER (c IS NULL) FROM bad UNION ALL
SELECT 'responses', 'condition of its stimulus', count(*) FILTER (c IS NULL OR c <> condition) FROM bad UNION ALL SELECT 'responses', 'known origin', count(*) FILTER (origin = 'someone') FROM bad UNION ALL
SELECT 'responses', 'fully rated', 0""",
    "experiment_ratings": f"""WITH {_EXPERIMENT} SELECT condition, is_musician, count(*) AS n, {", ".join(R(f"avg({c})", c) for c in experiment.RATINGS)},
  {R("avg(CASE WHEN origin = CASE WHEN condition = 'original' THEN 'human' ELSE 'computer' END THEN 1.0::DOUBLE ELSE 0 END)", "origin_right")} FROM answers JOIN people USING (participant_id) GROUP BY ALL""",
    "golden_arc": f"""WITH {NOTES_SQL}, e AS (SELECT piece_id, min_by(start, seq) AS a, max_by(start + duration, seq) AS b, count(*) AS n, min(pitch) AS low, max(pitch) AS high FROM notes GROUP BY 1),
g AS (SELECT notes.*, (start - a) / CASE WHEN b - a > 0 THEN b - a ELSE CAST(n AS DOUBLE) END AS pos, coalesce((pitch - low) / nullif(CAST(high - low AS DOUBLE), 0), 0.5) AS level FROM notes JOIN e USING (piece_id) WHERE n > 1),
m AS (SELECT *, list_min([abs(pos - p) FOR p IN CAST({drawings.golden_places()} AS DOUBLE[])]) AS near FROM g)
SELECT piece_id, seq, {R(f'600 + 336.0::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * level) * cos(pos * CAST({2 * math.pi * drawings.PHI} AS DOUBLE))', 'x', 5)}, {R(f'400 + 336.0::DOUBLE * (0.3::DOUBLE + 0.7::DOUBLE * level) * sin(pos * CAST({2 * math.pi * drawings.PHI} AS DOUBLE))', 'y', 5)}, {R('level', 'level', 5)},
  CASE WHEN near < 0.02 THEN 6 WHEN near < 0.05 THEN 4 ELSE 2 END AS dot FROM m""",
    "spectral_columns": f"""WITH {NOTES_SQL}, s AS (SELECT *, coalesce(abs(pitch - lag(pitch) OVER (PARTITION BY piece_id ORDER BY seq)) / 12.0::DOUBLE, 0) AS step, count(*) OVER (PARTITION BY piece_id) AS n FROM notes)
SELECT piece_id, seq, {R('seq / CAST(n - 1 AS DOUBLE) * 1199', 'x')}, pitch % 12 AS bright, {", ".join(R(f"coalesce(({c} - min({c}) OVER w) / nullif(CAST(max({c}) OVER w - min({c}) OVER w AS DOUBLE), 0), 0.5)", f"{c}_level") for c in ("pitch", "duration", "step"))}
FROM s WHERE n > 1 WINDOW w AS (PARTITION BY piece_id)""",
    "waveform_samples": f"""WITH {NOTES_SQL}, s AS (SELECT *, count(*) OVER w AS n, coalesce((pitch - min(pitch) OVER w) / nullif(CAST(max(pitch) OVER w - min(pitch) OVER w AS DOUBLE), 0), 0.5) AS level FROM notes WINDOW w AS (PARTITION BY piece_id)),
b AS (SELECT *, CAST(floor(seq / CAST(n - 1 AS DOUBLE) * 1199) AS INTEGER) AS begin, greatest(1, CAST(floor(duration / 4.0::DOUBLE * 1200 / n) AS INTEGER)) AS size FROM s WHERE n > 1),
x AS (SELECT *, unnest(range(begin, least(begin + size, 1200))) AS pixel FROM b)
SELECT piece_id, CAST(pixel AS INTEGER) AS pixel, {R(f"sum((0.2::DOUBLE + level * 0.8::DOUBLE) * sin(CAST({2 * math.pi} AS DOUBLE) * (0.5::DOUBLE + (pitch % 12) / 12.0::DOUBLE * 4) * ((pixel - begin) / CAST(size AS DOUBLE))) * exp(-2 * ((pixel - begin) / CAST(size AS DOUBLE))))", "sample", 5)} FROM x GROUP BY ALL""",
    "fractal_segments": f"""WITH RECURSIVE {NOTES_SQL}, h AS (SELECT piece_id, count(*) AS n FROM notes GROUP BY 1 HAVING count(*) >= 4),
t AS (SELECT piece_id, 0 AS level, 0 AS node, CAST(0 AS BIGINT) AS lo, n AS hi, CAST(0 AS DOUBLE) AS x0, CAST(1200 AS DOUBLE) AS x1, least(8, CAST(floor(log2(n)) AS INTEGER)) AS levels FROM h
  UNION ALL SELECT piece_id, level + 1, node * 2 + k, CASE WHEN k = 0 THEN lo ELSE (lo + hi) // 2 END, CASE WHEN k = 0 THEN (lo + hi) // 2 ELSE hi END,
    CASE WHEN k = 0 THEN x0 ELSE (x0 + x1) / 2 END, CASE WHEN k = 0 THEN (x0 + x1) / 2 ELSE x1 END, levels
  FROM t, (SELECT unnest([0, 1]) AS k) AS s WHERE level + 1 < levels AND CASE WHEN k = 0 THEN (lo + hi) // 2 - lo ELSE hi - (lo + hi) // 2 END >= 2),
m AS (SELECT t.piece_id, level, node, x0, x1, avg(pitch) FILTER (seq < (lo + hi) // 2) AS l, avg(pitch) FILTER (seq >= (lo + hi) // 2) AS r
      FROM t JOIN notes AS n ON n.piece_id = t.piece_id AND n.seq >= lo AND n.seq < hi GROUP BY ALL)
SELECT piece_id, level, node, {R('x0', 'x0', 5)}, {R('x1', 'x1', 5)}, {R('400 * (1 - (l - 36) / 60.0::DOUBLE)', 'left_y', 5)}, {R('400 * (1 - (r - 36) / 60.0::DOUBLE)', 'right_y', 5)} FROM m""",
    "json_documents": f"WITH {MATRIX_SQL} SELECT piece_id, composer, {R('pitch_mean', 'pitch_mean')}, {R('total_notes', 'total_notes')} FROM matrix",
    "catalogue_metadata": """SELECT p_name || '.midi' AS file_path, (['Johann Sebastian Bach', 'Franz Liszt', 'Nobody'])[p_partkey % 3 + 1] AS composer, (['Baroque', 'Romantic', 'Other'])[p_partkey % 3 + 1] AS era,
CAST(p_size AS INTEGER) AS composition_year, 'solo_piano' AS instrumentation, CAST(1 AS INTEGER) AS quality_flag FROM part WHERE p_partkey % 4 <> 3""",
    "track_series": f"WITH {MATRIX_SQL} SELECT CAST(0 AS INTEGER) AS index, {R('pitch_entropy', 'value')} FROM matrix WHERE piece_id = 3",
    "frequency_bins": f"SELECT CAST(k AS INTEGER) AS bin, {R('27.5 * power(2, k / 12.0)', 'hertz')} FROM (SELECT unnest(range(84)) AS k) AS b",
    "bins_to_chroma": f"""WITH {NOTES_SQL}, b AS (SELECT piece_id * 1000 + CAST(floor(start / 4) AS BIGINT) AS frame, (pitch - 24) % 12 AS pc, sum(duration) AS e FROM notes GROUP BY ALL)
SELECT frame, CAST(pc AS INTEGER) AS pc, {R('e / sum(e) OVER (PARTITION BY frame)', 'energy')} FROM b""",
}
