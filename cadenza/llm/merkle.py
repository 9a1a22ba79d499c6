"""Merkle manifest of a dataset by superblock reduction.

A row's leaf is a digest of its fields. The leaves of a source stand in the order of their ids; every ``fanout`` consecutive nodes become the
digest of their digests, until one is left, the source's subroot; subroots in the order of their sources give the root in the same way.

A round takes ``levels`` levels at once: a node's index divided by fanout ** levels is its superblock, and one grouped pandas function builds
the small tree of a superblock and hands out its root and, to each of its nodes, the proof from the node up to that root. Superblock roots are
the nodes of the next round. A node's whole proof is the lower one followed by that of its superblock's root, so proofs are put together from
the top round down, by joins on the superblock.

Positions are exact and distributed: rows are sorted by ranges of (source, id, leaf, number), rows of a range are numbered, and moved up by the
rows of their source in the ranges before. A source of any size, and any number of equal rows, is cut into ranges as the others are.

Defined results: a null field is ``-``, which no other value gives; an empty text is ``0:``; a null source is a source of its own before all
others, a null id comes before all others of its source; rows of equal source and id stand in the order of their leaves, and equal rows are
leaves of their own; an empty table gives an empty result; further columns are ignored, whatever their names are. Ids travel as strings and come
back in their own type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, remove, shared_dir, spread, table

FANOUT, LEVELS = 3, 7
#: The fields of a document's leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a range on average, when leaves are put in order.
RANGE_ROWS = 200_000
#: Superblock roots with their proofs, of at most about 3 KB each, that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROOTS = 2_000


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def encoded(field: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon and the value."""
    value = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(fields: Sequence[Column]) -> Column:
    return digest(*[encoded(f) for f in fields])


def _numbered(rows: DataFrame, stratum: str, order: list[str]) -> DataFrame:
    """rows with _index, the exact position from 0 in the stratum, and _n, the stratum's rows. ``order`` tells all rows apart."""
    rows = rows.withColumn("_range", F.spark_partition_id())
    folder = shared_dir(rows.sparkSession)
    rows.write.parquet(folder)
    rows = rows.sparkSession.read.parquet(folder)  # ranges are drawn from a sample: they are settled by being written
    sizes = rows.groupBy(stratum, "_range").agg(F.count("*").alias("_rows"))
    w = Window.partitionBy(stratum)
    sizes = sizes.withColumns({
        "_before": F.sum("_rows").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), "_n": F.sum("_rows").over(w)
    })
    sizes = sizes.select(F.col(stratum).alias("_stratum"), F.col("_range").alias("_of"), F.coalesce("_before", F.lit(0)).alias("_before"), "_n")
    inside = F.row_number().over(Window.partitionBy(stratum, "_range").orderBy(*order)) - 1
    joined = rows.withColumn("_inside", inside).join(sizes, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_range") == F.col("_of")))
    out = cut(joined.withColumn("_index", F.col("_before") + F.col("_inside")).drop("_stratum", "_of", "_before", "_inside", "_range"))
    remove(rows.sparkSession, folder)
    return out


def _levels_left(n: Column, fanout: int, levels: int) -> Column:
    """How many of the next ``levels`` levels a tree of n nodes has: levels go on while there are more nodes than one."""
    return reduce(lambda out, k: F.when(n > fanout ** (k - 1), k).otherwise(out), range(1, levels + 1), F.lit(0)).cast("int")


def _superblocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """One round. nodes: (stratum, _index, _n, node, ...). Returns them with _block, lower and block_root: lower is the list of left and right
    siblings, joined, of each level that the round took.
    """
    name = nodes.columns[0]
    nodes = nodes.withColumns({"_block": F.floor(F.col("_index") / fanout**levels).cast("long"), "_levels": _levels_left(F.col("_n"), fanout, levels)})

    def collapse(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_index")
        row, proofs = group["node"].tolist(), [[] for _ in range(len(group))]
        at = list(range(len(group)))  # the node of the present row above each node of the group
        for _ in range(int(group["_levels"].iloc[0])):
            for proof, k in zip(proofs, at):
                first = k - k % fanout
                proof += ["".join(row[first:k]), "".join(row[k + 1 : first + fanout])]
            row = [hashlib.sha256("".join(row[k : k + fanout]).encode()).hexdigest() for k in range(0, len(row), fanout)]
            at = [k // fanout for k in at]
        return group.assign(lower=proofs, block_root=row[0])

    schema = T.StructType([*nodes.schema.fields, T.StructField("lower", T.ArrayType(T.StringType())), T.StructField("block_root", T.StringType())])
    return nodes.groupBy(name, "_block").applyInPandas(collapse, schema)


def tree(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """nodes: (stratum, _index, _n, node, ...), one row per node, numbered from 0 within its stratum of _n rows; further columns, strings, are carried
    along. Returns nodes without _n, with proof and top: proof lists the siblings on the left and on the right, joined, level by level; top is
    the stratum's root.
    """
    name, kept, rounds = nodes.columns[0], [c for c in nodes.columns if c != "_n"], []
    while True:
        done = cut(_superblocks(nodes, fanout, levels))
        rounds.append(done)
        roots = done.where(F.col("_index") == F.col("_block") * fanout**levels)
        up = F.ceil(F.col("_n") / fanout**levels).cast("long").alias("_n")
        nodes = roots.select(name, F.col("_block").alias("_index"), up, F.col("block_root").alias("node"))
        if nodes.where("_n > 1").limit(1).count() == 0:
            break
    last = rounds[-1]
    above = last.select(*(kept if len(rounds) == 1 else [name, "_index"]), F.col("lower").alias("proof"), F.col("block_root").alias("top"))
    for k in reversed(range(len(rounds) - 1)):
        above = cut(above.select(F.col(name).alias("_stratum"), F.col("_index").alias("_of"), F.col("proof").alias("upper"), "top"))
        few = above.limit(BROADCAST_ROOTS + 1).count() <= BROADCAST_ROOTS
        match = F.col(name).eqNullSafe(F.col("_stratum")) & (F.col("_block") == F.col("_of"))
        joined = rounds[k].join(F.broadcast(above) if few else above, match)
        above = joined.select(*([name, "_index"] if k else kept), F.concat("lower", "upper").alias("proof"), "top")
    return above


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(proof) - 2, F.lit(2)), lambda i: F.struct(F.get(proof, i).alias("l"), F.get(proof, i + 1).alias("r")))
    pairs = F.when(F.size(proof) > 0, pairs).otherwise(F.array().cast("array<struct<l:string,r:string>>"))
    return F.aggregate(pairs, leaf, lambda node, p: F.sha2(F.concat(p["l"], node, p["r"]).cast("binary"), 256))


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, source_col: str = "source", id_col: str = "doc_id", fanout: int = FANOUT, levels: int = LEVELS,
    claimed: Column | None = None,
) -> DataFrame:
    """(id, source, leaf, claimed, subroot, root, proof): one row per row of docs. proof lists left and right siblings from leaf to root.

    claimed: a column of docs by which a copy is to be verified, such as leaf_of() of its fields; the leaf itself by default.
    """
    leaf = leaf_of([docs[f"`{c}`"] for c in fields])
    rows = cut(spread(docs).select(
        docs[f"`{source_col}`"].cast("string").alias("source"), docs[f"`{id_col}`"].alias("id"), leaf.alias("node"),
        (leaf if claimed is None else claimed).alias("claimed"), F.monotonically_increasing_id().alias("_tie"),
    ))
    order = ["source", "id", "node", "_tie"]
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    numbered = _numbered(rows.repartitionByRange(ranges, *order), "source", order[1:])
    carried = numbered.select("source", "_index", "_n", "node", F.col("id").cast("string").alias("id"), "claimed")
    lower = tree(carried, fanout, levels).withColumnRenamed("node", "leaf")
    subroots = cut(lower.where("_index = 0").select("source", F.col("top").alias("node")))
    ranges = max(1, -(-subroots.count() // RANGE_ROWS))
    tops = _numbered(subroots.withColumn("_all", F.lit(0)).repartitionByRange(ranges, "source"), "_all", ["source"])
    # as a string, a null source stays apart from an empty one
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("named")
    upper = tree(tops.select("_all", "_index", "_n", "node", named), fanout, levels)
    upper = cut(upper.select("named", F.col("node").alias("subroot"), F.col("top").alias("root"), F.col("proof").alias("upper")))
    few = upper.limit(BROADCAST_ROOTS + 1).count() <= BROADCAST_ROOTS
    joined = lower.withColumn("named", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).join(F.broadcast(upper) if few else upper, "named")
    kind = docs.schema[id_col].dataType
    return joined.select(F.col("id").cast(kind).alias("id"), "source", "leaf", "claimed", "subroot", "root", F.concat("proof", "upper").alias("proof"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof's digest, and whether a copy whose line ends were deleted in every other document still verifies."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    judged = manifest(docs, claimed=leaf_of([F.col(c) if c != "text" else tampered for c in FIELDS]))
    root = folded(F.col("claimed"), F.col("proof"))
    out = judged.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a short ASCII string, bit by bit: its polynomial is fixed.
_CRC32 = """(SELECT list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda crc, byte:
  list_reduce(list_prepend(xor(crc, byte), [CAST(0 AS BIGINT) FOR b IN range(8)]), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)))"""
_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({{{c}}} AS VARCHAR)) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in FIELDS) + ")"
_PLAIN = {c: c for c in FIELDS}


def _tree_sql(name: str, leaves: str, stratum: str, fanout: int = FANOUT) -> str:
    """The nodes of all levels, and the siblings of each leaf's way up: {name}_sides(stratum, i, lv, l, r) and {name}_top(stratum, h)."""
    return f"""
{name}_nodes AS (
  SELECT 0 AS lv, {stratum} AS s, i, n, h FROM {leaves}
  UNION ALL SELECT lv + 1, s, i // {fanout}, (max(n) + {fanout - 1}) // {fanout}, sha256(string_agg(h, '' ORDER BY i)) FROM {name}_nodes WHERE n > 1 GROUP BY lv, s, i // {fanout}),
{name}_top AS (SELECT s, h FROM {name}_nodes WHERE n = 1),
{name}_sides AS (
  SELECT a.{stratum} AS s, a.i, b.lv, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i // CAST(pow({fanout}, b.lv) AS BIGINT)), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i // CAST(pow({fanout}, b.lv) AS BIGINT)), '') AS r
  FROM {leaves} AS a JOIN {name}_nodes AS b
    ON a.{stratum} IS NOT DISTINCT FROM b.s AND b.n > 1 AND b.i // {fanout} = a.i // CAST(pow({fanout}, b.lv + 1) AS BIGINT)
  GROUP BY ALL)"""


QUERIES = {"op11_merkle": op11_merkle}
ORACLE_SQL = {
    "op11_merkle": f"""WITH RECURSIVE
given AS (SELECT *, {_CRC32.format(text="CAST(doc_id AS VARCHAR)")} AS crc FROM documents),
changed AS (SELECT doc_id, source, lang, n_chars, text, CASE WHEN xor(crc, CAST(4294967295 AS BIGINT)) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS copy FROM given),
leaves AS (
  SELECT doc_id, source, h, c, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
  FROM (SELECT doc_id, source, {_LEAF.format(**_PLAIN)} AS h, {_LEAF.format(**_PLAIN | {"text": "copy"})} AS c FROM changed) AS x),
{_tree_sql("low", "leaves", "source")},
subroots AS (SELECT 0 AS one, s AS source, h, row_number() OVER (ORDER BY s NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low_top),
{_tree_sql("high", "subroots", "one")},
way AS (
  SELECT source, i, lv, l, r FROM (SELECT s AS source, i, lv, l, r FROM low_sides) AS x
  UNION ALL SELECT a.source, a.i, 1000 + b.lv, b.l, b.r FROM leaves AS a JOIN subroots AS t ON a.source IS NOT DISTINCT FROM t.source JOIN high_sides AS b ON b.i = t.i),
steps AS (SELECT source, i, row_number() OVER (PARTITION BY source, i ORDER BY lv) AS k, l, r FROM way),
fold AS (
  SELECT source, i, CAST(1 AS BIGINT) AS k, c AS h FROM leaves
  UNION ALL SELECT f.source, f.i, f.k + 1, sha256(s.l || f.h || s.r) FROM fold AS f JOIN steps AS s ON f.source IS NOT DISTINCT FROM s.source AND f.i = s.i AND f.k = s.k),
ends AS (SELECT source, i, max_by(h, k) AS folded FROM fold GROUP BY source, i),
proofs AS (SELECT source, i, string_agg(l || r, '' ORDER BY k) AS p FROM steps GROUP BY source, i)
SELECT a.doc_id, a.h AS leaf, t.h AS subroot, g.h AS root, sha256(coalesce(p.p, '')) AS proof_sha256, e.folded AS folded_root, e.folded = g.h AS verified
FROM leaves AS a JOIN subroots AS t ON a.source IS NOT DISTINCT FROM t.source JOIN high_top AS g ON true
JOIN ends AS e ON a.source IS NOT DISTINCT FROM e.source AND a.i = e.i LEFT JOIN proofs AS p ON a.source IS NOT DISTINCT FROM p.source AND a.i = p.i"""
}
