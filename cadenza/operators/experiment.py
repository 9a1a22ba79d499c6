"""Listening experiments: participants, stimuli and responses, held to their schema, and ratings by condition.

Checks and summaries are aggregates and joins on ids; every rule's count comes from one pass over its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Conditions of stimuli, what a listener may take a piece for, and rated scales.
CONDITIONS = ("original", "generated", "baseline")
ORIGINS = ("human", "computer", "unknown")
RATINGS = ("likability", "beauty", "valence", "arousal")


def _counted(rows: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """(table, rule, n): how many rows break each rule; a null breaks it."""
    counts = rows.agg(*[F.count_if(~F.coalesce(holds, F.lit(False))).alias(name) for name, holds in rules.items()])
    return counts.unpivot([], list(rules), "rule", "n").select(F.lit(table).alias("table"), "rule", "n")


def _repeated(rows: DataFrame, table: str, key: str) -> DataFrame:
    again = rows.groupBy(key).count().where("count > 1")
    return again.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit(table).alias("table"), F.lit("unique id").alias("rule"), "n")


def violations(participants: DataFrame, stimuli: DataFrame, responses: DataFrame) -> DataFrame:
    """(table, rule, n): rows that break the schema, for every rule, 0 included."""
    known = responses.join(participants.select("participant_id").distinct().withColumn("_p", F.lit(True)), "participant_id", "left")
    own = stimuli.groupBy("stimulus_id").agg(F.first("condition").alias("_c"))
    known = known.join(own, "stimulus_id", "left")
    tables = [
        _repeated(participants, "participants", "participant_id"), _repeated(stimuli, "stimuli", "stimulus_id"),
        _counted(participants, "participants", {"training not negative": F.col("music_training_years") >= 0, "musician known": F.col("is_musician").isNotNull()}),
        _counted(stimuli, "stimuli", {"known condition": F.col("condition").isin(*CONDITIONS), "has a file": F.length("filepath") > 0}),
        _counted(known, "responses", {
            "known participant": F.col("_p"), "known stimulus": F.col("_c").isNotNull(), "condition of its stimulus": F.col("condition") == F.col("_c"),
            "known origin": F.col("perceived_origin").isin(*ORIGINS), "fully rated": F.forall(F.array(*RATINGS), lambda x: x.isNotNull()),
        }),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def ratings(participants: DataFrame, responses: DataFrame) -> DataFrame:
    """(condition, is_musician, n, the mean of each scale, origin_right): responses of known participants; origin_right is the share that took an
    original for a human's and others for a computer's.
    """
    right = F.col("perceived_origin") == F.when(F.col("condition") == "original", "human").otherwise("computer")
    met = responses.join(participants.select("participant_id", "is_musician").dropDuplicates(["participant_id"]), "participant_id")
    return met.groupBy("condition", "is_musician").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in RATINGS], F.avg(F.when(right, 1.0).otherwise(0.0)).alias("origin_right")
    )
