"""Runs of named steps that resume: each step's table is written once, and marked; a run that broke off goes on from what is there.

A step is a function of the tables of earlier steps. Its table counts as there once Spark's own success mark is, which is written after all of
its files; what a failed step left is overwritten. A step is run anew if one that it reads was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import new_folder
from ..sources.files import exists
from . import features, relational, statistics


@dataclass(frozen=True)
class Step:
    """A table of a run: its name, the names of the tables that it is made from, and how."""

    name: str
    reads: tuple[str, ...]
    make: Callable[..., DataFrame]


class Run:
    """Steps in order, in a folder of the shared one."""

    def __init__(self, spark: SparkSession, steps: list[Step], folder: str | None = None):
        known: set[str] = set()
        for step in steps:
            if step.name in known or not set(step.reads) <= known:
                raise ValueError(f"step {step.name} is there twice, or reads what no earlier step makes")
            known.add(step.name)
        self.spark, self.steps, self.folder = spark, steps, folder or new_folder(spark)

    def done(self, name: str) -> bool:
        return exists(self.spark, f"{self.folder}/{name}/_SUCCESS")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def resume(self) -> list[str]:
        """Makes what is missing; the names of the steps that it ran."""
        ran: list[str] = []
        for step in self.steps:
            if self.done(step.name) and not set(step.reads) & set(ran):
                continue
            step.make(*map(self.table, step.reads)).write.mode("overwrite").parquet(f"{self.folder}/{step.name}")
            ran.append(step.name)
        return ran


def pieces_run(
    spark: SparkSession, notes: DataFrame, pieces: DataFrame, columns: list[str], folder: str | None = None, least_notes: int = 50, most_duration: float = 1200.0
) -> Run:
    """The whole way from notes to analyses: quality flags, notes of clean pieces, their feature matrix, profiles by composer and era, and distances
    between composers.
    """

    def clean(flags: DataFrame) -> DataFrame:
        return notes.join(flags.where("quality_flag = 1").select("piece_id"), "piece_id", "left_semi")

    def profiles(by: str) -> Callable[[DataFrame], DataFrame]:
        return lambda matrix: statistics.profiles(matrix.where(F.col(by).isNotNull()), by, columns)

    return Run(spark, [
        Step("flags", (), lambda: relational.quality_flags(notes, least_notes, most_duration)), Step("notes", ("flags",), clean),
        Step("matrix", ("notes",), lambda n: features.feature_matrix(n, pieces)), Step("composers", ("matrix",), profiles("composer")),
        Step("eras", ("matrix",), profiles("era")),
    ], folder)
