"""Best-fit packing of documents into sequences of bounded length, by the sum of squares.

A document longer than a sequence is cut into full pieces, and a first piece that may be shorter; full pieces are sequences of their own. Other
pieces are placed one by one, longest first. Each goes to the open sequence for which the sum over all gaps of the squared number of open
sequences with that gap becomes smallest (Csirik, Johnson, Kenyon, Orlin, Shor and Weber, "On the Sum-of-Squares Algorithm for Bin Packing",
2006). A new sequence is opened only where no open one has room: in that form the result comes within a sequence or two of what the token count
allows, where opening new ones by the same measure takes about one per cent more.

Pieces are dealt to groups of bounded size by a seeded hash of their number; each group is packed in one task, which holds one counter for each
gap. What is left loose at the end, sequences with a gap of ``loose`` tokens or more, is undone; their pieces meet those of other groups in the
next round, as long as that leaves fewer than half of the pieces. The result does not depend on the partitions.

Defined results: a null text is an empty one, and has the end token alone; repeated rows and null ids are packed as rows of their own; an empty
table gives an empty result; further columns are ignored, whatever their names are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import apply_groups, cut, shared_dir, table

#: Tokens of a sequence, and the token that ends each document.
MOST, END_ID = 1024, 2
#: Pieces of a group on average, and the gap from which a sequence is undone and packed again with those of other groups.
GROUP_PIECES, LOOSE = 32_768, 16


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, in the order given; sequences are numbered from 0. No piece is longer than ``most``, none is empty."""
    counts = np.zeros(most + 1, np.int64)  # open sequences by gap
    never = np.iinfo(np.int64).max
    open_: list[list[int]] = [[] for _ in range(most + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = 0
    for k, length in enumerate(lengths.tolist()):
        have = counts[length:most]
        # the sum changes by (n' + 1)^2 - n'^2 at the gap that is left, and by (n - 1)^2 - n^2 at the gap that was; a full one counts no more, as counts[0] stays 0
        change = counts[: most - length] - have
        change[have == 0] = never
        best = int(change.argmin()) if len(change) else -1
        if best < 0 or change[best] == never:
            gap, s = most, n
            n += 1
        else:
            gap = best + length
            s = open_[gap].pop()
            counts[gap] -= 1
        sequence[k], offset[k] = s, most - gap
        if gap > length:
            open_[gap - length].append(s)
            counts[gap - length] += 1
    return sequence, offset


def _packed_group(most: int, loose: int):
    def run(group: pa.Table) -> pa.Table:
        lengths, piece = group.column("length").to_numpy().astype(np.int64), group.column("n").to_numpy()
        order = np.lexsort((piece, -lengths))
        sequence, offset = sum_of_squares(lengths[order], most)
        filled = np.bincount(sequence, lengths[order].astype(float)).astype(np.int64)
        columns = [pa.array(piece[order]), pa.array(lengths[order]), group.column("group").take(pa.array(order)), pa.array(sequence), pa.array(offset), pa.array(filled[sequence] + loose <= most)]
        return pa.table(columns, ["n", "length", "group", "local", "offset", "is_loose"])

    return run


def pack(pieces: DataFrame, most: int = MOST, group_pieces: int = GROUP_PIECES, loose: int = LOOSE, seed: int = 7) -> DataFrame:
    """(n, sequence_id, offset) of pieces (n, length), n being different whole numbers from 0 and length from 1 to ``most``.

    A piece of full length has the sequence -1 - n; others have numbers made of the round, the group and the sequence in the group.
    """
    full = pieces.where(F.col("length") == most).select("n", (-1 - F.col("n")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest, done, round_ = pieces.where(F.col("length") < most).select("n", "length"), [full], 0
    left = rest.count()
    while left:
        groups = -(-left // group_pieces)
        dealt = rest.withColumn("group", F.pmod(F.xxhash64(F.lit(seed + round_), "n"), F.lit(groups)))
        schema = "n bigint, length bigint, group bigint, local bigint, offset bigint, is_loose boolean"
        placed = cut(apply_groups(dealt, "group", _packed_group(most, loose), schema))
        again = placed.where("is_loose").count() if groups > 1 else 0
        settled = placed.where("not is_loose") if 0 < 2 * again < left else placed
        number = (F.lit(round_).cast("bigint") * (1 << 58)) + F.col("group") * (1 << 20) + F.col("local")
        done.append(settled.select("n", number.alias("sequence_id"), "offset"))
        if not 0 < 2 * again < left:
            break
        rest, left, round_ = placed.where("is_loose").select("n", "length"), again, round_ + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _cuts(n: int, most: int) -> list[int]:
    """Where the pieces of a document of n tokens begin, and its end: all pieces are full but the first."""
    return [*([0] if n % most else []), *range(n % most, n + 1, most)]


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, end_id: int = END_ID, path: str | None = None,
    keep_ids: bool = False, group_pieces: int = GROUP_PIECES, **sizes: int
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids) of every piece of every document."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)

    def columns(ids: list[np.ndarray]) -> list[pa.Array]:
        rows = []
        for x in ids:
            x = np.append(x, np.uint32(end_id))
            cuts = _cuts(len(x), most)
            parts = [x[a:b] for a, b in zip(cuts, cuts[1:])]
            rows.append([{"start": a, "length": len(p), "crc": _crc32(p), "ids": p.tolist() if keep_ids else None} for a, p in zip(cuts, parts)])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64()), ("ids", pa.list_(pa.int32()))]))
        return [pa.array(rows, kind)]

    schema = "pieces array<struct<start:bigint,length:bigint,crc:bigint,ids:array<int>>>"
    encoded = bpe.encode_columns(docs, id_col, text_col, path or bpe.vocabulary_path(), columns, schema, **sizes)
    pieces = encoded.select("id", F.posexplode("pieces").alias("piece", "p")).withColumn("n", F.monotonically_increasing_id())
    pieces.write.parquet(folder)  # numbers are settled by being written
    pieces = spark.read.parquet(folder)
    places = pack(pieces.select("n", F.col("p.length").alias("length")), most, group_pieces)
    out = pieces.join(places, "n")
    kept = [F.col("p.ids").alias("ids")] if keep_ids else []
    return out.select(
        "id", "piece", F.col("p.start").alias("start"), F.col("p.length").alias("length"), F.col("p.crc").alias("ids_crc32"), "sequence_id", "offset", *kept
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts) from pack_documents() with keep_ids: the tokens of each sequence, and where its pieces begin in it, for masks
    that keep documents apart. A sequence is a group of at most ``most`` tokens.
    """
    rows: Column = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    return grouped.select("sequence_id", F.flatten(F.col("rows.ids")).alias("ids"), F.col("rows.offset").alias("starts"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded and ended, in sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {"op13_packing": op13_packing}
