"""Queries of further table verbs, of files in and out, and of streams."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..functions.storage import checkpoint_dir, new_folder
from ..operators import markov, relational, statistics
from ..operators import tables as op
from ..sources import files, midi, views
from ..sources.views import NOTES_SQL, PIECES_SQL, table
from ..streaming import notes as stream
from . import sequences
from . import statistics as statistic_plans
from .features import matrix


def _ord(s, d):
    return table(s, d, "orders")


def _through(write, read):
    """customer, written in a folder of the shared one and read back."""

    def run(s, d):
        customer, path = table(s, d, "customer"), new_folder(s)
        write(customer, path)
        return rounded(read(s, path, customer.schema), 4)

    return run


def _kept_markov(s, d):
    path = new_folder(s)
    files.save_model(markov.transitions(views.notes(s, d), markov.pitch_class()), path)
    return rounded(files.load_model(s, path))


def _kept_profiles(s, d):
    path = new_folder(s)
    files.save_model(statistics.profiles(matrix(s, d), "composer", statistic_plans.COLUMNS), path)
    return rounded(files.load_model(s, path))


def _through_midi(s, d):
    """The notes, as MIDI files and back."""
    made = midi.files_of(views.notes(s, d).withColumn("program", F.lit(7)))
    return rounded(
        midi.notes_of(made, "piece_id").select(F.col("file").cast("bigint").alias("piece_id"), "program", "pitch", "velocity", "start", "duration")
    )


def _clean(s, d):
    """Pieces of the tables that pass the quality check, with composer and era."""
    fine = relational.quality_flags(views.notes(s, d), 60, 70.0).where("quality_flag = 1").select("piece_id")
    return views.pieces(s, d).join(fine, "piece_id", "left_semi")


def _as_of(s, d):
    events = table(s, d, "events").select("user_id", "ts", "event_id", "event_type")
    errors = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("error_id"))
    return op.as_of(events, errors, "user_id", "ts", "since", ["error_id", "since"], "error_id").select(
        "event_id", F.coalesce("error_id", F.lit(-1)).alias("error_id"),
        F.coalesce(F.unix_micros(F.col("since").cast("timestamp")), F.lit(-1)).alias("since_us")
    )


def _streamed(make):
    """What a stream over the event file gives, once it has read all that is there."""

    def run(s, d):
        checkpoint_dir(s)
        out = stream.run_to_end(make(stream.event_stream(s, f"{d}/events*.parquet")), new_folder(s), new_folder(s))
        return rounded(out)

    return run


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal + 1.3e-9, 4) + 0.0 AS c_acctbal, c_mktsegment FROM customer"

QUERIES = {
    "set_intersect": lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("nation")).intersect(
        table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"))
    ),
    "set_difference": lambda s, d: table(s, d, "documents").select("doc_id").subtract(table(s, d, "labels").select("doc_id")),
    "cube_counts": lambda s, d: views.pieces(s, d).cube("era", "composer").agg(
        F.count("*").alias("pieces"), F.grouping_id().cast("int").alias("level")
    ),
    "grouping_sets": lambda s, d: rounded(
        _ord(s, d).groupingSets(
            [["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority"
        ).agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean_price")),
        4
    ),
    "as_of_join": _as_of,
    "full_join": lambda s, d: table(s, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers")).join(
        table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers")), "nation", "full_outer"
    ),
    "right_join": lambda s, d: _ord(s, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_orderkey").alias("keys")).join(
        table(s, d, "customer").select("c_custkey"), "c_custkey", "right"
    ),
    "sort_merge_join": lambda s, d: _ord(s, d).hint("merge").join(
        table(s, d, "lineitem").hint("merge"), F.col("o_orderkey") == F.col("l_orderkey")
    ).groupBy("o_orderpriority").agg(F.count("*").alias("lines")),
    "shuffle_hash_join": lambda s, d: table(s, d, "lineitem").join(
        _ord(s, d).hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey")
    ).groupBy("o_orderstatus").agg(F.count("*").alias("lines")),
    "date_parts": lambda s, d: _ord(s, d).groupBy(
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"),
        F.date_format(F.date_trunc("quarter", "o_orderdate"), "yyyy-MM-dd").alias("quarter"), F.weekday("o_orderdate").alias("weekday")
    ).agg(
        F.count("*").alias("orders"), F.max(F.date_diff(F.last_day("o_orderdate"), F.to_date("o_orderdate"))).alias("days_left")),
    "null_values": lambda s, d: _ord(s, d).select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status")
    ).na.drop(subset=["status"]).union(
        _ord(s, d).where("o_orderstatus = 'O'").select("o_orderkey", F.nvl(F.nullif("o_orderstatus", F.lit("O")), F.lit("open")).alias("status"))
    ),
    "approximate_distinct": lambda s, d: _ord(s, d).groupBy("o_orderstatus").agg(
        (F.abs(F.approx_count_distinct("o_custkey", 0.02) - F.count_distinct("o_custkey")) <= 0.1 * F.count_distinct("o_custkey")).alias("close")
    ),
    "train_test_split": lambda s, d: op.split(views.pieces(s, d).select("piece_id"), "piece_id"),
    "random_sample": lambda s, d: op.shuffled_sample(_ord(s, d).select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 10),
    "sorted_rows": lambda s, d: table(s, d, "supplier").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey").select("s_suppkey", "s_name"),
    "csv_files": _through(files.write_csv, files.read_csv), "json_files": _through(files.write_json, files.read_json),
    "stored_markov_model": _kept_markov, "stored_profiles": _kept_profiles,
    "python_aggregate": lambda s, d: rounded(op.geometric_mean(_ord(s, d), "o_orderpriority", "o_totalprice"), 2),
    "python_table_function": lambda s, d: op.triples(views.notes(s, d)),
    "stream_counts": _streamed(lambda e: stream.windowed_counts(e).select(F.unix_seconds("window.start").alias("hour"), "event_type", "n", "total")),
    "stream_sessions": _streamed(lambda e: stream.sessions(e).select("user_id", F.unix_micros("session_window.start").alias("begin_us"), "n")),
    "midi_files": _through_midi, "clean_dataset": _clean,
    "note_names": lambda s, d: views.notes(s, d).groupBy(files.note_name(F.col("pitch")).alias("name")).agg(F.count("*").alias("n")),
}
_HASH = lambda c: f"CAST(('0x' || substr(md5('42:' || {c}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
ORACLE_SQL = {
    "set_intersect": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_difference": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "cube_counts": f"WITH {PIECES_SQL} SELECT era, composer, count(*) AS pieces, CAST(grouping(era, composer) AS INTEGER) AS level FROM pieces GROUP BY CUBE (era, composer)",
    "grouping_sets": f"SELECT o_orderstatus, o_orderpriority, count(*) AS orders, {R('avg(o_totalprice)', 'mean_price', 4)} FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "as_of_join": """WITH e AS (SELECT user_id, ts, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT a.event_id, coalesce(e.error_id, -1) AS error_id, coalesce(epoch_us(e.ts), -1) AS since_us FROM events AS a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.ts >= e.ts""",
    "full_join": "SELECT nation, customers, suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer GROUP BY 1) AS a FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1) AS b USING (nation)",
    "right_join": "SELECT c_custkey, CAST(keys AS BIGINT) AS keys FROM (SELECT o_custkey AS c_custkey, sum(o_orderkey) AS keys FROM orders GROUP BY 1) AS o RIGHT JOIN (SELECT c_custkey FROM customer) AS c USING (c_custkey)",
    "sort_merge_join": "SELECT o_orderpriority, count(*) AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "shuffle_hash_join": "SELECT o_orderstatus, count(*) AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "date_parts": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, count(*) AS orders,
CAST(max(date_diff('day', CAST(o_orderdate AS DATE), last_day(o_orderdate))) AS INTEGER) AS days_left FROM orders GROUP BY ALL""",
    "null_values": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders",
    "approximate_distinct": "SELECT o_orderstatus, true AS close FROM orders GROUP BY 1",
    "train_test_split": f"WITH {PIECES_SQL} SELECT piece_id, {_HASH('piece_id')} < 0.2 AS is_test FROM pieces",
    "random_sample": f"SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_HASH('o_orderkey')}, o_orderkey) AS k FROM orders) AS r WHERE k <= 10",
    "sorted_rows": "SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey",
    "csv_files": _CUSTOMER, "json_files": _CUSTOMER,
    "stored_markov_model": sequences.ORACLE_SQL["markov_pitch_model"], "stored_profiles": statistic_plans.ORACLE_SQL["composer_profiles"],
    "python_aggregate": f"SELECT o_orderpriority, {R('exp(avg(ln(o_totalprice)))', 'geometric_mean', 2)} FROM orders GROUP BY 1",
    "python_table_function": f"""WITH {NOTES_SQL}, t AS (SELECT piece_id, CAST(seq AS INTEGER) AS position, CAST(pitch AS INTEGER) AS a, lead(pitch) OVER w AS b, lead(pitch, 2) OVER w AS c FROM notes WINDOW w AS (PARTITION BY piece_id ORDER BY seq))
SELECT piece_id, position, a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c FROM t WHERE c IS NOT NULL""",
    "stream_counts": f"SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type, count(*) AS n, {R('sum(value)', 'total')} FROM events GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 600000000 THEN 0 ELSE 1 END AS j FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(j) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(epoch_us(ts)) AS begin_us, count(*) AS n FROM s GROUP BY user_id, k""",
    "midi_files": f"WITH {NOTES_SQL} SELECT piece_id, CAST(7 AS INTEGER) AS program, pitch, CAST(64 AS INTEGER) AS velocity, {R('start', 'start')}, {R('duration', 'duration')} FROM notes",
    "clean_dataset": f"WITH {NOTES_SQL}, {PIECES_SQL}, q AS (SELECT piece_id, count(*) AS n, max(start + duration) AS t FROM notes GROUP BY 1) SELECT piece_id, composer, era FROM pieces JOIN q USING (piece_id) WHERE n >= 60 AND t <= 70",
    "note_names": f"WITH {NOTES_SQL} SELECT (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[pitch % 12 + 1] || CAST(pitch // 12 - 1 AS VARCHAR) AS name, count(*) AS n FROM notes GROUP BY 1",
}
