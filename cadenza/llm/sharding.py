"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; sorted by fractional rank (rank + phase) / rows of the source, any
contiguous cut holds each source in proportion. Cutting at equal row counts gives the law "rows": shard sizes differ by one at most.

The phase sets sources apart from each other. Sources of equal size are ranked by a seeded hash themselves, and their phases are spread
evenly over the unit interval from a seeded start, so that eight thousand sources of one row fill the shards as evenly as one source of
eight thousand rows does, instead of standing all at one half.

Ranks are exact and distributed: the seeded hash is uniform, so its leading bits deal each stratum into small buckets; a bucket's rows are
numbered within the bucket and moved up by the rows of the buckets before it. Those sums are made in two levels, groups of buckets and
buckets in a group, so that no task takes more than one group. A bucket that equal rows overfill is dealt on by a row number. The same is
done with fractional ranks. No task gets a whole source, however large, nor a whole group of equal rows.

Defined results: a null text has size 1 and the checksum of the empty text; a null source is a source of its own; a null id is an id like
any other; repeated rows each get a slot of their own; an empty table gives an empty result (and no shard files); columns other than the
three named are ignored, or carried along by write_shards() whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, remove, shared_dir, table

#: Rows that a bucket has on average (buckets follow the row count), and buckets of a group.
BUCKET_ROWS, GROUP_BUCKETS = 2048, 4096
#: A bucket of more than so many times the average is dealt on by row number.
OVERFULL = 16
#: Overfull buckets, of some 50 bytes each, that are broadcast at most; more are joined by a shuffle.
BROADCAST_BUCKETS = 20_000
_EARLIER = (Window.unboundedPreceding, -1)


def _dealt(rows: DataFrame, strata: list[str], order: list[str], tie: str, bucket_rows: int) -> DataFrame:
    """Adds _first and _deal, by which an overfull bucket falls apart: its rows stay in the order of ``order[0]``, and equal ones are dealt by
    ``tie``.
    """
    at = [*strata, "_bucket"]
    sizes = rows.groupBy(*at).agg(F.count("*").alias("_n")).where(F.col("_n") > OVERFULL * bucket_rows)
    full = cut(sizes.select(*at, F.ceil(F.col("_n") / bucket_rows).alias("_parts")))
    n = full.limit(BROADCAST_BUCKETS + 1).count()
    zero = F.lit(0).cast(rows.schema[order[0]].dataType)
    if not n:
        return rows.withColumns({"_first": zero, "_deal": F.lit(0).cast("long")})
    rows = rows.join(F.broadcast(full) if n <= BROADCAST_BUCKETS else full, at, "left")
    first = F.when(F.col("_parts").isNotNull(), F.col(order[0])).otherwise(zero)
    deal = F.coalesce(F.pmod(F.col(tie), F.col("_parts")), F.lit(0)).cast("long")
    return rows.withColumns({"_first": first, "_deal": deal}).drop("_parts")


def _positions(
    rows: DataFrame, strata: list[str], bucket: Column, order: list[str], tie: str, name: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Adds each row's exact position from 0 in its stratum, in the order of ``order`` and then ``tie``; rows equal in ``order[0]`` may stand
    in any order.

    ``bucket`` is a column of integers from 0 that rises with ``order[0]``; ``tie`` is a column of integers from 0 that differ within a stratum.
    """
    rows = _dealt(rows.withColumn("_bucket", bucket.cast("long")), strata, order, tie, bucket_rows)
    rows = rows.withColumn("_group", F.floor(F.col("_bucket") / GROUP_BUCKETS))
    key = ["_group", "_bucket", "_first", "_deal"]
    counts = rows.groupBy(*strata, *key).agg(F.count("*").alias("_n"))
    groups = counts.groupBy(*strata, "_group").agg(F.sum("_n").alias("_all"))
    before = F.sum("_all").over(Window.partitionBy(*strata).orderBy("_group").rowsBetween(*_EARLIER))
    groups = groups.withColumn("_groups_before", F.coalesce(before, F.lit(0))).drop("_all")
    inside = F.sum("_n").over(Window.partitionBy(*strata, "_group").orderBy(*key[1:]).rowsBetween(*_EARLIER))
    counts = counts.withColumn("_before", F.coalesce(inside, F.lit(0))).drop("_n").join(groups, [*strata, "_group"])
    within = F.row_number().over(Window.partitionBy(*strata, *key).orderBy(*order, tie)) - 1
    numbered = rows.withColumn("_within", within).join(counts, [*strata, *key])
    position = F.col("_groups_before") + F.col("_before") + F.col("_within")
    return numbered.withColumn(name, position.cast("long")).drop(*key, "_before", "_groups_before", "_within")


def _leading_bits(h: Column, buckets: int) -> Column:
    """The bucket, of a power of two of them, of a hash whose sign bit is flipped, so that signed order is the unsigned order of the hash."""
    return F.shiftrightunsigned(h.bitwiseXOR(F.lit(_SIGN)), 65 - buckets.bit_length())


def _buckets(rows: int, bucket_rows: int) -> int:
    return 1 << max(6, (rows // bucket_rows).bit_length())


_SIGN = -(1 << 63)


def _phases(rows: DataFrame, seed: int, bucket_rows: int) -> DataFrame:
    """(source, _rows, _phase): the size of each source, and its phase in [0, 1): spread evenly among sources of equal size, from a seeded start."""
    sizes = cut(rows.groupBy("source").agg(F.count("*").alias("_rows"), F.min("_tie").alias("_tie")))
    sizes = sizes.withColumn("_h", F.xxhash64(F.lit(seed), "source").bitwiseXOR(F.lit(_SIGN)))
    buckets = _buckets(sizes.count(), bucket_rows)
    ranked = _positions(sizes, ["_rows"], _leading_bits(F.col("_h"), buckets), ["_h", "source"], "_tie", "_nth", bucket_rows)
    alike = sizes.groupBy("_rows").agg(F.count("*").alias("_alike"))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "_rows"), F.lit(1 << 30)) / float(1 << 30)
    return ranked.join(alike, "_rows").select("source", "_rows", ((F.col("_nth") + start) / F.col("_alike")).alias("_phase"))


def _placed(rows: DataFrame, shards: int, seed: int, bucket_rows: int) -> DataFrame:
    """rows (_tie, source, and the columns that are hashed) with shard and slot."""
    hashed = [c for c in rows.columns if c not in ("_tie", "source")]
    rows = cut(rows.withColumn("_h", F.xxhash64(F.lit(seed), *hashed).bitwiseXOR(F.lit(_SIGN))))
    total = rows.count()
    buckets = _buckets(total, bucket_rows)
    ranked = _positions(rows, ["source"], _leading_bits(F.col("_h"), buckets), ["_h", *hashed], "_tie", "_rank", bucket_rows)
    ranked = ranked.join(_phases(rows, seed, bucket_rows), "source")
    ranked = ranked.withColumn("_fraction", (F.col("_rank") + F.col("_phase")) / F.col("_rows"))
    level = F.least(F.floor(F.col("_fraction") * buckets), F.lit(buckets - 1))
    placed = _positions(ranked, [], level, ["_fraction", "_h", "source", *hashed], "_tie", "_position", bucket_rows)
    n = max(total, 1)
    if total * shards < 1 << 50:
        shard = F.floor(F.col("_position") * shards / F.lit(n)).cast("int")
    else:
        shard = F.expr(f"cast((cast(_position as decimal(38,0)) * {shards}) div {n} as int)")
    begins = F.ceil(F.col("shard").cast("decimal(20,0)") * F.lit(n) / shards).cast("long")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_position") - begins)


def _narrow(id_col: Column, text_col: Column, source_col: Column, tie: Column) -> list[Column]:
    text = F.coalesce(text_col.cast("string"), F.lit(""))
    return [
        id_col.alias("id"), F.coalesce(F.concat(F.lit("="), source_col.cast("string")), F.lit("")).alias("source"),
        (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), tie.alias("_tie"),
    ]


def interleave(
    docs: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot): one row per row of docs. slot counts from 0 without gaps in each shard."""
    tie = F.monotonically_increasing_id()  # settled when the rows are cut; only rows that are equal are told apart by it
    rows = docs.select(*_narrow(docs[f"`{id_col}`"], docs[f"`{text_col}`"], docs[f"`{source_col}`"], tie))
    source = F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source")
    return _placed(rows, shards, seed, bucket_rows).select("id", source, "size", "text_crc32", "shard", "slot")


def write_shards(
    docs: DataFrame, path: str, shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    file_rows: int = 200_000,
) -> None:
    """Writes docs, all columns, as Parquet in folders _shard=k (underscores added at the end if docs has that column), in files of about
    ``file_rows`` rows.

    Files of a folder hold runs of slots, in order of their names. The rows are numbered in a copy in the shared folder, by which they are
    put in place, so that no ids are needed that tell them apart.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("n")).write.parquet(folder)
    numbered = spark.read.parquet(folder)
    narrow = numbered.select(*_narrow(F.col("row")[id_col], F.col("row")[text_col], F.col("row")[source_col], F.col("n")))
    places = cut(_placed(narrow, shards, seed, BUCKET_ROWS).select(F.col("_tie").alias("n"), "shard", "slot"))
    name = "_shard"
    while name in docs.columns:
        name += "_"
    files = max(shards, -(-places.count() // file_rows))
    ranged = numbered.join(places, "n").repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot")
    ranged.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    remove(spark, folder)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place under the law ``rows``: eight shards, counts at most one apart, each source in proportion in each."""
    placed = interleave(table(spark, sf_dir, "documents"), 8)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", law, "shard", "slot", grown)


QUERIES = {"op9_sharding": op9_sharding}
