"""Streams in append mode against plain loops, and sketches against exact values."""

import math

import pytest
from pyspark.sql import functions as F

from cadenza.operators import sketches
from cadenza.plans import streams
from cadenza.streaming import events as stream


@pytest.fixture(scope="module")
def arrivals(spark):
    return stream.in_quarters(streams._events(spark, "/root/testdata/sf0.01"), True)


def test_late_rows_are_those_that_the_stream_leaves_out(spark, arrivals):
    counted = stream.run_arrivals(spark, arrivals, lambda e: stream.hourly(e, "30 minutes"))
    late = stream.late_rows(arrivals, 1800)
    assert late.count() > 50
    every = arrivals[0].unionByName(arrivals[1]).unionByName(arrivals[2]).unionByName(arrivals[3])
    mark = every.agg(F.max(F.unix_millis("ts"))).first()[0] - 1_800_000
    on_time = every.join(late.select("event_id"), "event_id", "left_anti").where((F.floor(F.unix_seconds("ts") / 3600) + 1) * 3_600_000 <= mark)
    want = {(r[0], r[1]): r[2] for r in on_time.groupBy((F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("h"), "event_type").count().collect()}
    got = counted.collect()
    assert {(r["hour"], r["event_type"]): r["n"] for r in got} == want and len(got) == len(want)  # appended once


def test_timers_report_silent_users_as_a_plain_loop_does(spark, arrivals):
    silence, delay = 86_400_000, 1_800_000
    state, want, mark, latest = {}, [], None, 0
    for rows in arrivals:
        batch = [(r["user_id"], r["ms"], r["event_id"], r["value"]) for r in rows.select("user_id", F.unix_millis("ts").alias("ms"), "event_id", "value").collect()]
        by = {}
        for user, ms, event, value in batch:
            if mark is None or ms > mark:  # rows that the watermark has passed are left out
                by.setdefault(user, []).append((ms, event, value))
        for user, events in by.items():
            level, variance, n, last = state.get(user, (None, 1.0, 0, 0))
            for ms, _, x in sorted(events):
                if level is None:
                    level = x
                else:
                    gain = (variance + 0.01) / (variance + 0.01 + 0.1)
                    level, variance = level + gain * (x - level), (1 - gain) * (variance + 0.01)
                n, last = n + 1, max(last, ms)
            state[user] = (level, variance, n, last)
        latest = max([latest, *(x[1] for x in batch)])
        mark = latest - delay
        for user in [u for u, s in state.items() if s[3] + silence <= mark]:
            want.append((user, *state.pop(user)))
    got = stream.run_arrivals(spark, arrivals, lambda e: stream.levels(e, 86_400, "30 minutes")).collect()
    rows = lambda xs: sorted((u, round(a, 9), round(v, 9), n, m) for u, a, v, n, m in xs)
    assert rows([tuple(r) for r in got]) == rows(want) and len(want) > 20


def test_estimates_are_within_their_bounds_and_merge(spark):
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    rows = streams._distinct(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 5 and all(r["low"] <= r["exact"] <= r["high"] and r["parts"] > 12 and r["high"] - r["low"] < 0.11 * r["exact"] for r in rows)
    assert sum(r["n"] for r in rows) == orders.count()
    quantiles = streams._quantiles(spark, "/root/testdata/sf0.1").collect()
    assert len(quantiles) == 25
    for r in quantiles:
        assert r["low"] <= r["exact"] <= r["high"] and r["low"] <= r["estimate"] <= r["high"]
        below = orders.where(F.col("o_orderpriority") == r["o_orderpriority"]).agg(F.avg((F.col("o_totalprice") <= r["estimate"]).cast("double"))).first()[0]
        assert abs(below - r["rank"]) < 2 * sketches.rank_error()


def test_states_of_parts_without_values(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("b", 1, None)], "k string, p int, x int")
    stored = sketches.states(rows, ["k"], "p", "x", "x")
    got = {r["k"]: (r["n"], r["estimate"]) for r in sketches.distinct_estimates(stored, ["k"]).collect()}
    assert got == {"a": (2, 1.0), "b": (1, 0.0)}
    assert sketches.states(rows.limit(0), ["k"], "p", "x").count() == 0


def test_percentiles_are_exact_whatever_the_accuracy(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "a").when(F.col("id") % 3 == 0, None).otherwise("b").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("n", None), ("b", None)], "g string, v long"))
    ranks = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["rank"]): r["value"] for r in sketches.percentiles(rows, ["g"], "v", ranks, accuracy=50).collect()}
    values = {}
    for r in rows.collect():
        values.setdefault(r["g"], []).extend([] if r["v"] is None else [r["v"]])
    want = {(g, r): sorted(v)[max(0, math.ceil(len(v) * r) - 1)] if v else None for g, v in values.items() for r in ranks}
    assert got == want
