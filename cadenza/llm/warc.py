"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading splits files anywhere. Text between two record magics is one row; the magics before rows are candidate record starts, true or inside a
payload. Each task reports its candidates with the start of the record that would follow by their Content-Length. Only the chain from the
start of each file is true: within a split it is followed at once, across splits by pointer jumping, in rounds logarithmic in the splits.

Defined results: a null payload is an empty one; a null id makes an empty identifier and reads back null; rows that share id and payload are
written as one another's equals; an empty table gives no archive and an empty result; other columns are ignored. A record whose successor is
no record start, in a damaged archive, ends its file's chain; what comes after it is rejected. Payloads may hold any bytes when read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, map_batches, remove, shared_dir, table

MAGIC = "WARC/1.0\r\n"
_NAMED = "urn:cadenza:page:"
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT_BYTES = 100
#: Rows that refer to others that are broadcast at most.
BROADCAST_ROWS = 200_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _id_text(column: Column) -> Column:
    return F.concat(F.lit(f"<{_NAMED}"), F.coalesce(column.cast("string"), F.lit("")), F.lit(">"))


def with_references(
    pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = LEAST_REVISIT_BYTES, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """pages' (id, url if any, payload, bytes, digest, refers_to). Of equal payloads of at least ``least_bytes`` bytes, all but the one with
    the least id refer to it.

    Digests are grouped with map-side combine and only the rows that refer to another come back, joined by id, so neither step gathers a
    group of copies. Up to ``broadcast_rows`` of them are sent to where the payloads are; more are joined by a shuffle of both sides.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(
        F.col(id_col).alias("id"), url.alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"),
        F.sha2(payload.cast("binary"), 256).alias("digest")
    )
    narrow = rows.where(F.col("bytes") >= least_bytes).select("id", "digest")
    first = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = narrow.join(first, "digest").where(F.col("id") > F.col("first")).select("id", "digest", F.col("first").alias("refers_to")).distinct()
    revisits = cut(revisits)
    if revisits.limit(broadcast_rows + 1).count() <= broadcast_rows:  # about 100 bytes each
        revisits = F.broadcast(revisits)
    return rows.join(revisits, ["id", "digest"], "left")


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", date: str = "2000-01-01T00:00:00Z",
    least_bytes: int = LEAST_REVISIT_BYTES
) -> None:
    """Writes uncompressed archives into a folder of any file system, by Spark's own text writer: a record is a line that ends in two line breaks."""
    rows = with_references(pages, id_col, payload_col, least_bytes)
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: "), _id_text(F.col("id"))),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), _id_text(F.col("refers_to")))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
    ]
    record = F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(F.col("payload")))
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


_FIELD = {
    k: re.compile(rb"^" + name + rb":[ \t]*(.*?)[ \t]*\r?$", re.I | re.M) for k,
    name in {
        "type": b"WARC-Type", "id": b"WARC-Record-ID", "uri": b"WARC-Target-URI", "refers_to": b"WARC-Refers-To", "digest": b"WARC-Payload-Digest",
        "length": b"Content-Length"
    }.items()
}
_SCAN = "path string, block bigint, rel bigint, size bigint, head bigint, length bigint, type string, id string, uri string, refers_to string, digest string, whole_sha256 string"


def scan(spark: SparkSession, path: str, values: bool = False) -> DataFrame:
    """A row for each stretch that follows a magic: split (path, block), byte position in the split, size with its magic, header size and
    fields, the digest of its payload if all of it is there, and the bytes themselves if asked for.
    """
    text = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    )
    names = [x.split()[0] for x in _SCAN.split(", ")] + ["value"] * values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if split != (file, block):
                    split, at = (file, block), 0
                end = value.find(b"\r\n\r\n")
                head = value[:end] if end >= 0 else b""
                found = {k: m[1].decode("utf-8", "replace") if (m := p.search(head)) else None for k, p in _FIELD.items()}
                length = int(found["length"]) if found["length"] and found["length"].isascii() and found["length"].isdigit() and len(found["length"]) < 18 else None
                whole = length is not None and len(value) >= end + 4 + length
                row = [
                    file, block, at, len(value) + len(MAGIC), end + 4, length, found["type"], found["id"], found["uri"], found["refers_to"],
                    found["digest"], hashlib.sha256(memoryview(value)[end + 4 : end + 4 + length]).hexdigest() if whole else None
                ]
                for column, x in zip(out, row + [value] * values):
                    column.append(x)
                at += len(value) + len(MAGIC)
            types = [pa.int64() if n in ("block", "rel", "size", "head", "length") else pa.binary() if n == "value" else pa.string() for n in names]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types)], names)

    return map_batches(text, run, _SCAN + ", value binary" * values)


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one split: where the chain from each candidate leaves the split."""
    rows = rows.sort_values("at", ascending=False)
    leaves: dict[int, int] = {}
    for at, after in zip(rows["at"].tolist(), rows["after"].tolist()):
        leaves[at] = leaves.get(after, after)
    return rows.assign(leaves=[leaves[at] for at in rows["at"].tolist()])


def _follow(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one split: the candidates on the chain from its true entry."""
    after = dict(zip(rows["at"].tolist(), rows["after"].tolist()))
    chain, at = [], min(rows.loc[rows["entry"], "at"].tolist(), default=None)
    while at in after:
        chain.append(at)
        at = after[at]
    return rows[rows["at"].isin(chain)][["file", "at"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, at) of the records on the chain from the start of each file. candidates: (file, block, at, after), with after > at or null."""
    candidates = candidates.where(F.col("after").isNotNull())
    kept = "file bigint, block bigint, at bigint, after bigint"
    local = cut(candidates.groupBy("file", "block").applyInPandas(_exits, kept + ", leaves bigint"))
    targets = local.select("file", F.col("leaves").alias("at")).distinct()
    starts = candidates.where("at = 0").select("file", "at").distinct()
    jumps = cut(local.join(targets.unionByName(starts).distinct(), ["file", "at"], "left_semi").select("file", "at", F.col("leaves").alias("to")))
    reached = starts
    splits = local.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(splits).bit_length()):  # after k rounds the first 2^k splits of each file are reached
        reached = cut(reached.unionByName(reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))).distinct())
        further = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("next"))
        jumps = cut(jumps.join(further, ["file", "to"], "left").select("file", "at", F.coalesce("next", "to").alias("to")))
    entries = reached.withColumn("entry", F.lit(True))
    flagged = local.join(entries, ["file", "at"], "left").select("file", "block", "at", "after", F.coalesce("entry", F.lit(False)).alias("entry"))
    return flagged.groupBy("file", "block").applyInPandas(_follow, "file bigint, at bigint")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(path, offset, type, id, uri, refers_to, digest, payload_bytes, payload_sha256, payload if asked for) of the true records of all
    archives in a folder.
    """
    rows = cut(scan(spark, path).withColumn("file", F.xxhash64("path")))
    blocks = rows.groupBy("path", "block").agg(F.sum("size").alias("total"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = blocks.select("path", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = rows.join(bases, ["path", "block"]).withColumn("at", F.col("base") + F.col("rel") - len(MAGIC)).withColumn(
        "after", F.col("at") + len(MAGIC) + F.col("head") + F.col("length") + 4
    )
    placed = placed.where("at >= 0")
    true = placed.join(reachable(placed.select("file", "block", "at", "after")), ["file", "at"])
    spanning = cut(true.where("whole_sha256 is null").select("path", "block", "at", "after", "head", "length"))
    pieces = _pieces(spark, path, spanning, placed) if payloads or not spanning.isEmpty() else None
    out = true.select(
        "path", "block", "rel", F.col("at").alias("offset"), "type", "id", "uri", "refers_to", "digest", F.col("length").alias("payload_bytes"),
        F.col("whole_sha256").alias("payload_sha256"), "head", "length"
    )
    if pieces is not None:
        out = out.join(pieces.withColumnRenamed("at", "offset"), ["path", "offset"], "left")
        out = out.where("payload_sha256 is not null or pieced is not null").withColumn(
            "payload_sha256", F.coalesce("payload_sha256", F.sha2("pieced", 256))
        )
    if payloads:
        values = scan(spark, path, values=True).select("path", "block", "rel", "value")
        own = F.expr("substring(value, cast(head as int) + 1, cast(length as int))")
        out = out.join(values, ["path", "block", "rel"]).withColumn("payload", F.coalesce("pieced", own))
    return out.select("path", "offset", "type", "id", "uri", "refers_to", "digest", "payload_bytes", "payload_sha256", *["payload"] * payloads)


def _pieces(spark: SparkSession, path: str, spanning: DataFrame, placed: DataFrame) -> DataFrame:
    """(path, at, pieced): payloads with magics inside, put together from the stretches between them. Stretches meet records by split, so no
    file is gathered; what meets on the path alone is a row for each such record and each split of one file.
    """
    reach = placed.groupBy("path", "block").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    s = spanning.select("path", F.col("at").alias("start"), "after", "head", "length")
    where = s.join(reach, "path").where("low < after and high >= start").select("path", "block", "start", "after", "head", "length")
    stretches = placed.select("path", "block", "rel", "at").join(where, ["path", "block"]).where("at >= start and at < after")
    values = scan(spark, path, values=True).select("path", "block", "rel", "value")
    found = stretches.join(values, ["path", "block", "rel"]).groupBy("path", "start", "head", "length").agg(
        F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts")
    )
    bytes_ = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, F.lit(MAGIC.encode()), p["value"]))
    joined = found.withColumn("all", bytes_).withColumn(
        "pieced", F.expr(f"substring(all, cast({len(MAGIC)} + head as int) + 1, cast(length as int))")
    )
    return joined.where(F.octet_length("pieced") == F.col("length")).select("path", F.col("start").alias("at"), "pieced")


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) as read back from archives of pages. Revisits get both figures from the
    record that they refer to.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    path = shared_dir(spark)
    write(pages, path, id_col, payload_col)
    number = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '{_NAMED}([^>]*)>', 1), '') as {kind})")
    records = cut(
        read(spark, path).select(
            number("id").alias("id"), "type", number("refers_to").alias("refers_to"), F.substring_index("digest", ":", -1).alias("digest"),
            "payload_bytes", "payload_sha256"
        )
    )
    remove(spark, path)
    responses = records.where("type = 'response'").select(
        F.col("id").alias("refers_to"), F.col("payload_sha256").alias("digest"), F.col("payload_bytes").alias("full_bytes")
    ).distinct()
    revisits = records.where("type = 'revisit'").join(responses, ["refers_to", "digest"], "left")
    shown = lambda n: (F.col("id"), F.col(n).alias("payload_bytes"), F.col("digest" if n == "full_bytes" else "payload_sha256").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers_to"))
    return records.where("type = 'response'").select(*shown("payload_bytes")).unionByName(revisits.select(*shown("full_bytes")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


QUERIES = {"op7_warc": op7_warc}
ORACLE_SQL = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to FROM f"""
}
