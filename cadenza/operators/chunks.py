"""Jobs in chunks that resume: a result is a table partitioned by chunk, and a chunk that failed is run again by itself.

Keys are dealt to chunks by a hash. A chunk's rows are written by dynamic partition overwrite, so a chunk that is run again replaces its own rows
and no others, and a chunk that fails half way leaves what was there before. A chunk counts as done once its mark is written, after its
rows. What all chunks gave can be kept as a bucketed table, which later joins and groups by the key read without a shuffle.

Null keys are in chunk 0; an empty chunk is done with no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import new_folder
from ..sources.files import exists

_MARKS = "chunk int, rows bigint"


def chunk_of(key: str, chunks: int) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(key), F.lit(chunks)), F.lit(0)).cast("int") if chunks > 1 else F.lit(0)


class ChunkedJob:
    """A job over rows with a key: ``compute`` takes the rows of a chunk, whole keys at a time, and returns rows with the key."""

    def __init__(self, rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], chunks: int, folder: str | None = None):
        self.rows, self.key, self.compute, self.chunks = rows, key, compute, chunks
        self.spark: SparkSession = rows.sparkSession
        self.folder = folder or new_folder(self.spark)

    @property
    def _results(self) -> str:
        return f"{self.folder}/results"

    @property
    def _marks(self) -> str:
        return f"{self.folder}/marks"

    def run_chunk(self, chunk: int) -> None:
        """Runs one chunk, replacing what it may have given before."""
        out = self.compute(self.rows.where(chunk_of(self.key, self.chunks) == chunk))
        out.withColumn("chunk", F.lit(chunk)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(self._results)
        counted = self._read_chunk(chunk, out.schema).count()
        mark = self.spark.range(1).select(F.lit(counted).cast("bigint").alias("rows"), F.lit(chunk).alias("chunk"))
        mark.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(self._marks)

    def _read_chunk(self, chunk: int, schema: object) -> DataFrame:
        path = f"{self._results}/chunk={chunk}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def status(self) -> DataFrame:
        """(chunk, done, rows) of every chunk."""
        every = self.spark.range(self.chunks).select(F.col("id").cast("int").alias("chunk"))
        if not exists(self.spark, self._marks):
            return every.select("chunk", F.lit(False).alias("done"), F.lit(0).cast("bigint").alias("rows"))
        marks = self.spark.read.schema(_MARKS).parquet(self._marks)
        return every.join(marks, "chunk", "left").select("chunk", F.col("rows").isNotNull().alias("done"), F.coalesce("rows", F.lit(0)).alias("rows"))

    def resume(self) -> list[int]:
        """Runs the chunks that are not done, one after another; those it ran. A failure leaves the chunks before it done."""
        missing = [r["chunk"] for r in self.status().where("not done").orderBy("chunk").collect()]
        for chunk in missing:
            self.run_chunk(chunk)
        return missing

    def merge(self) -> DataFrame:
        """The rows of all chunks. Chunks that are not done are an error: a partial result is never taken for a whole one."""
        left = self.status().where("not done").count()
        if left:
            raise RuntimeError(f"{left} of {self.chunks} chunks are not done")
        schema = self.compute(self.rows.limit(0)).schema
        if not exists(self.spark, self._results):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self._results}/chunk={k}" for k in range(self.chunks) if exists(self.spark, f"{self._results}/chunk={k}")])

    def keep(self, buckets: int, table: str | None = None) -> DataFrame:
        """The merged rows as a table in buckets by the key, sorted in each, in the job's folder."""
        table = table or f"chunked_{uuid.uuid4().hex}"
        self.merge().write.bucketBy(buckets, self.key).sortBy(self.key).option("path", f"{self.folder}/{table}").format("parquet").saveAsTable(table)
        return self.spark.table(table)
