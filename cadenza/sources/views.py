"""Sequence views over the input tables. A piece is one user's events in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pitch of each event type in the narrow voice, and its place among them.
VOICES = {"view": (60, 0), "click": (62, 1), "purchase": (64, 2), "signup": (67, 3), "error": (69, 4)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece_id, seq, pitch, duration, start, event_type, value): the wide voice. seq counts from 0."""
    order = Window.partitionBy("piece_id").orderBy("ts", "event_id")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("piece_id"), "ts", "event_id", "event_type", "value",
        ((F.get_json_object("props", "$.k").cast("int") % 16 + 1) / 8.0).alias("duration"),
    )
    events = events.withColumn("seq", F.row_number().over(order) - 1)
    before = F.sum("duration").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return events.select(
        "piece_id", "seq", (F.floor("value").cast("int") % 61 + 36).alias("pitch"), "duration", F.coalesce(before, F.lit(0.0)).alias("start"),
        "event_type", "value"
    )


def motes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes with the pitches of the narrow voice."""
    pitch = F.lit(None).cast("int")
    for kind, (p, _) in VOICES.items():
        pitch = F.when(F.col("event_type") == kind, F.lit(p)).otherwise(pitch)
    return notes(spark, sf_dir).withColumn("pitch", pitch)


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece_id, composer, era): composer and era by nation and region, which are broadcast as they are fixed tables of 25 and 5 rows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    who = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").cast("bigint").alias("_k"), F.col("n_name").alias("composer"), F.col("r_name").alias("era")
    )
    ids = table(spark, sf_dir, "events").select(F.col("user_id").alias("piece_id")).distinct()
    return ids.join(F.broadcast(who), F.col("piece_id") % 25 == F.col("_k")).select("piece_id", "composer", "era")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(piece_id, event_type, entry, exit, note_count, velocity): one interval per piece and event type, from its first event to its last."""
    return notes(spark, sf_dir).groupBy("piece_id", "event_type").agg(
        F.min("start").alias("entry"), F.max(F.col("start") + F.col("duration")).alias("exit"), F.count("*").alias("note_count"),
        F.avg("value").alias("velocity")
    )


#: The same views in SQL.
NOTES_SQL = """
notes AS (
  SELECT piece_id, seq, pitch, duration, CAST(coalesce(sum(duration) OVER (PARTITION BY piece_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS start, event_type, value
  FROM (SELECT user_id AS piece_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq, CAST(floor(value) AS INTEGER) % 61 + 36 AS pitch,
               CAST((CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) % 16 + 1) / 8.0 AS DOUBLE) AS duration, event_type, value FROM events) AS e)"""
MOTES_SQL = NOTES_SQL + """,
motes AS (SELECT piece_id, seq, CASE event_type WHEN 'view' THEN 60 WHEN 'click' THEN 62 WHEN 'purchase' THEN 64 WHEN 'signup' THEN 67 WHEN 'error' THEN 69 END AS pitch, duration, start FROM notes)"""
PIECES_SQL = """
pieces AS (SELECT piece_id, n_name AS composer, r_name AS era FROM (SELECT DISTINCT user_id AS piece_id FROM events) AS p JOIN nation ON piece_id % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
INSTRUMENTS_SQL = NOTES_SQL + """,
instruments AS (
  SELECT piece_id, event_type, min(start) AS entry, max(start + duration) AS exit, count(*) AS note_count, avg(value) AS velocity
  FROM notes GROUP BY piece_id, event_type)"""
