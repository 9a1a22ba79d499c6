"""Queries of streams in append mode and of mergeable sketches."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..functions.storage import checkpoint_dir, new_folder
from ..operators import sketches
from ..sources.views import table
from ..streaming import events as stream

LATE, LATE_SECONDS, SILENCE_SECONDS = "30 minutes", 1800, 86_400


def _events(s, d):
    checkpoint_dir(s)
    return table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _appended(make, straggle):
    return lambda s, d: rounded(stream.run_arrivals(s, stream.in_quarters(_events(s, d), straggle), make))


def _late(s, d):
    late = stream.late_rows(stream.in_quarters(_events(s, d), True), LATE_SECONDS)
    return late.select("event_id", "user_id", F.unix_micros("ts").alias("ts_us"), "arrival")


def _purchases_and_errors(events):
    of = lambda kind: events.where(F.col("event_type") == kind).select("ts", "user_id", F.col("event_id").alias(f"{kind}_id"))
    met = stream.follows(of("purchase"), of("error"), ["user_id"], "2 hours", LATE)
    return met.select("user_id", "purchase_id", "error_id", (F.unix_micros("second_ts") - F.unix_micros("first_ts")).alias("gap_us"))


def _stored_states(s, d):
    """States of each month's orders, stored by month and read back."""
    path, orders = new_folder(s), table(s, d, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    sketches.states(orders, ["o_orderpriority"], "month", "o_custkey", "o_totalprice").write.partitionBy("month").parquet(path)
    return s.read.parquet(path)


def _distinct(s, d):
    estimated = sketches.distinct_estimates(_stored_states(s, d), ["o_orderpriority"])
    exact = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("exact"))
    return rounded(estimated.join(exact, "o_orderpriority"))


def _quantiles(s, d):
    ranks = [0.05, 0.25, 0.5, 0.75, 0.95]
    estimated = sketches.quantile_estimates(_stored_states(s, d), ["o_orderpriority"], ranks)
    exact = table(s, d, "orders").groupBy("o_orderpriority").agg(F.percentile("o_totalprice", F.array(*map(F.lit, ranks))).alias("v"))
    exact = exact.select("o_orderpriority", F.posexplode("v").alias("_k", "exact"))
    exact = exact.select("o_orderpriority", F.element_at(F.array(*map(F.lit, ranks)), F.col("_k") + 1).alias("rank"), "exact")
    return rounded(estimated.join(exact, ["o_orderpriority", "rank"]))


QUERIES = {
    "stream_hourly_append": _appended(lambda e: stream.hourly(e, LATE), True), "stream_late_rows": _late,
    "stream_silent_users": _appended(lambda e: stream.levels(e, SILENCE_SECONDS, LATE), True),
    "stream_interval_join": _appended(_purchases_and_errors, False),
    "distinct_sketches": _distinct, "quantile_sketches": _quantiles,
    "approximate_percentiles": lambda s, d: rounded(sketches.percentiles(table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", [0.1, 0.5, 0.9]), 4),
}
_ARRIVALS = f"""e AS (SELECT *, epoch_us(ts) AS us, (epoch_us(ts) // 3600000000 + 1) * 3600000 AS ends FROM events),
b AS (SELECT min(us) AS a, max(us) + 1 AS z FROM e),
p AS (SELECT e.*, CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 50 = 0 THEN 3 ELSE CAST((us - a) * 4 // (z - a) AS INTEGER) END AS arrival FROM e, b),
w AS (SELECT k, max(us // 1000) - {LATE_SECONDS * 1000} AS mark FROM p JOIN (SELECT unnest(range(1, 5)) AS k) AS x ON arrival < k GROUP BY k),
j AS (SELECT p.*, coalesce(ends <= mark, false) AS is_late FROM p LEFT JOIN w ON arrival = k)"""
ORACLE_SQL = {
    "stream_hourly_append": f"""WITH {_ARRIVALS} SELECT ends // 1000 - 3600 AS hour, event_type, count(*) AS n, {R('sum(value)', 'total')}
FROM j WHERE NOT is_late AND ends <= (SELECT mark FROM w WHERE k = 4) GROUP BY ALL""",
    "stream_late_rows": f"WITH {_ARRIVALS} SELECT event_id, user_id, us AS ts_us, arrival FROM j WHERE is_late",
    "stream_interval_join": """SELECT a.user_id, a.event_id AS purchase_id, b.event_id AS error_id, epoch_us(b.ts) - epoch_us(a.ts) AS gap_us
FROM events AS a JOIN events AS b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'error' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR""",
    "approximate_percentiles": """WITH o AS (SELECT l_returnflag, l_quantity, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)),
r AS (SELECT CAST(unnest([0.1, 0.5, 0.9]) AS DOUBLE) AS rank) SELECT l_returnflag, rank, round(CAST(min(l_quantity) AS DOUBLE) + 1.3e-9, 4) + 0.0 AS value FROM o, r WHERE k >= ceil(n * rank) GROUP BY ALL""",
}
