"""What several operators of this subpackage share: table access, the shared folder, and word splitting on whole byte buffers.

Word splitting works on the UTF-8 bytes of an Arrow string column at once. A word is a maximal run of bytes of a given class, so the
classes used here ("not ASCII white space", "ASCII letter or digit, or any byte of a non-ASCII character") give the same words as the
character patterns they stand for. Word and window identities are 64-bit polynomial hashes computed from prefix sums.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Text bytes that one vectorised step takes at most, unless a single text is longer.
SLICE_BYTES = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_WINDOW_MULTIPLIER = 0xD6E8FEB86659FD93 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared folder. Where the session names none, one is set on a single machine, and a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        base = context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="cadenza-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/cadenza-{uuid.uuid4().hex}"


#: Rows of a file that cut() writes, where the row count is known.
CUT_ROWS = 50_000


def spread(docs: DataFrame) -> DataFrame:
    """``docs``, dealt out to all cores if it comes from fewer files than there are cores: a file of one row group is one task's work otherwise.
    Text work is never put into fewer tasks than its input has.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if 0 < len(docs._jdf.inputFiles()) < cores else docs


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Computes ``df`` once and cuts its lineage, in the shared folder, so that a lost executor costs no recomputation.

    rows: about so many rows there are, of a few numbers each. They go into files of CUT_ROWS rows, not into one for each partition, of which
    small tables in many rounds would write thousands. Rows that hold texts or sets are cut without it.
    """
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession).rpartition("/")[0])
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // CUT_ROWS)))
    return df.checkpoint(eager=True)


#: Ids, and bytes of them, that without() broadcasts at most.
BROADCAST_IDS, BROADCAST_BYTES = 200_000, 4 << 20


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of docs whose id is not in the one column of ``ids``; a null id equals a null id. The ids are counted: few go to the rows by
    broadcast, so that texts stay where they are, and more meet them in a shuffle.
    """
    gone = cut(ids.select(ids.columns[0]).distinct().toDF("_gone"), docs.count())
    size = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("_gone").cast("string"))), F.lit(0)).alias("b")).first()
    few = size["n"] <= BROADCAST_IDS and size["b"] <= BROADCAST_BYTES
    return docs.join(F.broadcast(gone) if few else gone, docs[f"`{id_col}`"].eqNullSafe(gone["_gone"]), "left_anti")


#: Bytes of an Arrow batch that goes to a Python worker, unless a single row is longer. Spark's own bound is 64 MB, held several times over.
BATCH_BYTES = 4 << 20
_BATCH_CONF = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b")


def _bound_batches(spark: SparkSession) -> None:
    """Sets the session's bound on Arrow batches where nobody has set another one."""
    name, default = _BATCH_CONF
    if spark.conf.get(name, None) == default:
        spark.conf.set(name, str(BATCH_BYTES))


#: What Python workers may keep from one task to the next of a kind of work, and how they give it back.
KEPT: dict[str, Callable[[], None]] = {}


def _give_back(keeps: str | None) -> None:
    """In a worker, before a task: gives back what other kinds of work have kept, since a worker lives on and serves many stages."""
    for kind, release in KEPT.items():
        if kind != keeps:
            release()


def map_batches(df: DataFrame, run: Callable, schema: str | StructType, keeps: str | None = None) -> DataFrame:
    """mapInArrow with batches of at most about BATCH_BYTES. keeps: the kind of work in KEPT that this is, if any."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back(keeps)
        yield from run(batches)

    _bound_batches(df.sparkSession)
    return df.mapInArrow(task, schema)


def apply_groups(df: DataFrame, key: str, run: Callable, schema: str | StructType, keeps: str | None = None) -> DataFrame:
    """applyInArrow by one key, with batches of at most about BATCH_BYTES; keeps as in map_batches()."""

    def task(group: pa.Table) -> pa.Table:
        _give_back(keeps)
        return run(group)

    _bound_batches(df.sparkSession)
    return df.groupBy(key).applyInArrow(task, schema)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_dir() named, by whatever file system it is in."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def _class_of(pattern: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(pattern)] = True
    return lut


#: [^\x20\x09-\x0D]: all bytes but ASCII white space.
NOT_SPACE = ~_class_of(b" \t\n\x0b\x0c\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z, bytes of non-ASCII characters.
ALNUM = _class_of(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: A-Z to a-z, all else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits a string column into runs of rows [i, j) of about ``most`` bytes: i, j, the bytes, and the j - i + 1 offsets into them. A null
    text is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _powers(multiplier: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    filled, step = 1, multiplier
    while filled < n:  # doubling: each round appends what is there, times the next power
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * np.uint64(step)
        step = step * step % (1 << 64)
        filled += take
    return out


#: Powers that a worker keeps at most, of each multiplier.
_KEPT_POWERS = (1 << 19) + (1 << 16)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(multiplier: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier modulo 2^64, and of its inverse."""
    have = _POWERS.get(multiplier)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        have = (_powers(multiplier, size), _powers(pow(multiplier, -1, 1 << 64), size))
        if size <= _KEPT_POWERS:
            _POWERS[multiplier] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash() gets the hash of any span of bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_MULTIPLIER, len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(_MULTIPLIER, len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def window_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` consecutive hashes; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(_WINDOW_MULTIPLIER, len(hashes))
    prefix = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=prefix[1:])
    return mix((prefix[width:] - prefix[:n]) * inverse[:n])


class Words:
    """The words of a run of texts: ``starts`` and ``ends`` are byte positions, ``first[d]`` to ``first[d + 1]`` are the words of text d."""

    __slots__ = ("data", "ends", "first", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = False):
        if lower:
            data = LOWER[data]
        inside = kind[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0], edge[-1] = False, False
        edge[1:-1] = inside[1:] & inside[:-1]  # position i continues a word that covers i - 1
        edge[offsets] = False
        begins, goes_on = inside & ~edge[:-1], edge[1:]
        self.data = data
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(inside & ~goes_on) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self) -> np.ndarray:
        """The text that each word is in, by position."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.starts, self.ends)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + width) of some s."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:-1]) > 0
