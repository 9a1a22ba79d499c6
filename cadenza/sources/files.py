"""Files in and out: delimited text with a header, JSON lines, stored models, configuration and collections of files."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a piece's metadata.
METADATA = (
    "file_path string, composer string, full_name string, birth_year int, death_year int, era string, composition_year int, form string, key string, instrumentation string, "
    "tempo_marking string, duration_seconds double, total_notes int, source string, quality_flag int, quality_note string"
)


#: What stands for a null in delimited text.
_NULL = "\\N"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by whatever file system it names."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def _texts(df: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return df.select(*[change(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _one_line(text: Column) -> Column:
    """A text without line breaks: backslashes are doubled, and a break is \\n or \\r. So no text is the mark of a null either."""
    for sign, written in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(sign), F.lit(written))
    return text


def _from_one_line(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    return F.array_join(parts, "\\")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, foreign: bool = False) -> DataFrame:
    """A table of delimited text with a header line, as write_csv() writes it; a missing path gives an empty table.

    Files are cut at lines, so that a large one is many tasks. With ``foreign``, texts are taken as they stand and quoted fields may hold line breaks;
    such a file is one task.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=foreign, escape='"', nullValue=_NULL)
    return rows if foreign else _texts(rows, _from_one_line)


def write_csv(df: DataFrame, path: str) -> None:
    """Delimited text with a header line in each file; quotes are doubled, line breaks in texts are written as \\n and \\r, and a null is \\N, so that it
    is no empty text, nor any other.
    """
    _texts(df, _one_line).write.mode("overwrite").csv(
        path, header=True, escape='"', nullValue=_NULL, emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A table of JSON lines; a missing path gives an empty table."""
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are written."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def save_model(model: DataFrame, path: str) -> None:
    """Keeps a model (transitions, profiles) as Parquet."""
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def metadata_template(spark: SparkSession, folder: str, pattern: str = "*.mid") -> DataFrame:
    """One row of METADATA for each file under a folder, with a good quality flag and nothing else known. Contents are not read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select(
        F.col("path").alias("file_path")
    )
    fields = T.StructType.fromDDL(METADATA).fields
    defaults = {"quality_flag": F.lit(1), **{f.name: F.lit("") for f in fields if isinstance(f.dataType, T.StringType)}}
    return listed.select("file_path", *[defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields[1:]])


#: Tables of a listening experiment.
PARTICIPANTS = "participant_id string, age_group string, music_training_years int, is_musician boolean"
STIMULI = "stimulus_id string, condition string, style string, filepath string"
RESPONSES = (
    "participant_id string, stimulus_id string, condition string, likability double, beauty double, valence double, arousal double, perceived_era string, perceived_origin string"
)


def catalogue_metadata(listing: DataFrame, source: str = "maestro", instrumentation: str = "solo_piano") -> DataFrame:
    """METADATA of a recording catalogue (midi_filename, canonical_composer, year, duration), MIDI files only; eras by composer, Other for
    those unknown.
    """
    from ..operators.relational import era_of

    path, composer = F.trim("midi_filename"), F.trim(F.coalesce("canonical_composer", F.lit("Unknown")))
    known = {
        "file_path": path, "composer": composer, "full_name": composer, "birth_year": F.lit(0), "death_year": F.lit(0), "era": era_of(composer),
        "composition_year": F.coalesce("year", F.lit(0)),
        "instrumentation": F.lit(instrumentation), "duration_seconds": F.coalesce("duration", F.lit(0.0)), "total_notes": F.lit(0),
        "source": F.lit(source), "quality_flag": F.lit(1),
    }
    rows = listing.where(path.endswith(".mid") | path.endswith(".midi"))
    return rows.select(*[known.get(f.name, F.lit("")).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(METADATA).fields])


def to_documents(df: DataFrame, id_col: str) -> DataFrame:
    """(id, document): all other columns of a row as one JSON object."""
    return df.select(id_col, F.to_json(F.struct(*[c for c in df.columns if c != id_col]), {"ignoreNullFields": "false"}).alias("document"))


def from_documents(documents: DataFrame, id_col: str, schema: str | T.StructType) -> DataFrame:
    """The columns of ``schema`` from such documents; a document that cannot be read gives nulls."""
    return documents.select(id_col, F.from_json("document", schema).alias("d")).select(id_col, "d.*")


def numeric_features(df: DataFrame) -> list[str]:
    """Names of the numeric columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


@dataclass(frozen=True)
class Config:
    """Where things are, and the seed."""

    data: str = "data"
    output: str = "results"
    seed: int = 42


def load_config(spark: SparkSession, path: str | None = None) -> Config:
    """The defaults, with what a JSON object at ``path`` says instead; names that Config does not have are an error."""
    if path is None or not exists(spark, path):
        return Config()
    return replace(Config(), **json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())))


def note_name(pitch: Column) -> Column:
    """The name of a pitch, with 60 as C4."""
    names = F.array(*[F.lit(n) for n in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")])
    return F.concat(F.get(names, F.pmod(pitch, F.lit(12)).cast("int")), (F.floor(pitch / 12) - 1).cast("string"))
