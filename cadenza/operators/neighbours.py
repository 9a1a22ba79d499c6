"""Nearest neighbours of vectors: exact search in blocks, and an index of coarse lists with product-quantised residuals.

Rows and queries meet in blocks: rows are dealt to parts of bounded size, queries to blocks of bounded size, and each part meets each block in
one task of a cogrouped shuffle, which returns the best few of the part for each query. Nothing is broadcast that grows with the data, and no
pair of rows becomes a row of its own before it is among the best of its part.

Where all rows are queries, ``neighbours_of_all`` meets large parts with large blocks, so that each row is sent and answered few times. It looks
into the same lists, but compares the vectors themselves, which travel with the rows.

The index (Jegou, Douze and Schmid, "Product Quantization for Nearest Neighbor Search", 2011) is fitted on a bounded sample: k-means centres
are the lists, and what is left of a vector after its centre is cut into short pieces, each written as the number of the nearest of 256 values.
A query looks into the lists whose centres are nearest, as many as the sample needs for ``recall``; it ranks their rows by the written
vectors, and only the best ``refine`` of them are compared with the vectors themselves.

Vectors that are null, of another length than most, or of no length have score 0 with all others.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import stored

#: Rows of a part and queries of a block.
PART_ROWS, BLOCK_QUERIES = 4096, 2048
#: Rows that the index is fitted on at most, rows of a list on average where the sample allows it, and lists at most.
FIT_ROWS, LIST_ROWS, MOST_LISTS = 20_000, 2048, 600
#: Coordinates of a part's rows and of a block's queries where all rows are queries, and queries compared at a time.
PART_SIZE, BLOCK_SIZE, TILE = 1 << 23, 1 << 22, 1024
#: Coordinates of a quantised piece, values it may have, rounds of k-means.
PIECE, VALUES, ROUNDS = 2, 256, 8


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of unit length; rows of zeros for those that are null, of another length, or of no length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out = np.zeros((len(column), width))
    fits = np.asarray(column.value_lengths().fill_null(-1)) == width
    if fits.any():
        out[fits] = np.asarray(column.filter(pa.array(fits)).flatten().cast(pa.float64()).fill_null(0.0)).reshape(-1, width)
    out = np.nan_to_num(out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1.0)


def _width(vectors: DataFrame, vector_col: str) -> int:
    """The most frequent length of the vectors."""
    sizes = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("w")).count()
    first = sizes.orderBy(F.desc("count"), "w").first()
    return first["w"] if first else 1


def _best(scores: np.ndarray, own: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the ``top`` best scores of each query, and all that equal the last of them; ``own`` marks the query itself."""
    scores = np.where(own, -np.inf, scores)
    if scores.shape[1] > top:
        least = -np.partition(-scores, top - 1, axis=1)[:, top - 1 : top]
    else:
        least = np.full((len(scores), 1), -2.0)
    return np.nonzero((scores >= least) & ~own)


def _met(rows: DataFrame, queries: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    return rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, schema)


def _blocks(queries: DataFrame, count: int) -> tuple[DataFrame, int]:
    blocks = max(1, -(-count // BLOCK_QUERIES))
    return queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")), blocks


def _each(n: int | Column) -> Column:
    """One row for each number below n."""
    return F.explode(F.sequence(F.lit(0), (F.lit(n) if isinstance(n, int) else n) - 1))


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "neighbour")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def exact(
    vectors: DataFrame, queries: DataFrame, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = PART_ROWS
) -> DataFrame:
    """(query, neighbour, score, rank): the best ``top`` other rows of each query by cosine, rounded to nine digits; ties by id."""
    width, kind = _width(vectors, vector_col), vectors.schema[id_col].dataType.simpleString()
    parts = max(1, -(-vectors.count() // part_rows))
    dealt, blocks = _blocks(queries.select(F.col(id_col).alias("query"), F.col(vector_col).alias("qv")), queries.count())
    rows = vectors.select(F.col(id_col).alias("neighbour"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("neighbour"), F.lit(parts)).cast("int")).withColumn("block", _each(blocks))

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, names = rows.column("neighbour").combine_chunks(), queries.column("query").combine_chunks()
        scores = np.round(matrix(queries.column("qv"), width) @ matrix(rows.column("v"), width).T, 9) + 0.0
        own = np.equal.outer(np.asarray(names), np.asarray(ids))
        q, r = _best(scores, own, top)
        return pa.table({"query": names.take(pa.array(q)), "neighbour": ids.take(pa.array(r)), "score": pa.array(scores[q, r])})

    met = _met(rows, dealt.withColumn("part", _each(parts)), ["part", "block"], run, f"query {kind}, neighbour {kind}, score double")
    return _ranked(met, top)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        at = _closest(x, centres)
        n = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * (x @ centres.T)).argmin(axis=1)


@dataclasses.dataclass(frozen=True)
class Model:
    """What an index is made with: list centres, the values of each piece of a residual, and how many lists a query looks into. Its size is bounded by
    MOST_LISTS and VALUES, whatever the table's.
    """

    width: int
    centres: np.ndarray
    values: list[np.ndarray]
    probes: int

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, code) of each row."""
        lists = _closest(x, self.centres)
        rest = x - self.centres[lists]
        codes = [_closest(rest[:, k * PIECE : (k + 1) * PIECE], v) for k, v in enumerate(self.values)]
        return lists, np.stack(codes, axis=1).astype(np.uint8)

    def decode(self, of: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes of one list stand for."""
        return self.centres[of] + np.concatenate([v[codes[:, k]] for k, v in enumerate(self.values)], axis=1)

    def lists(self, queries: np.ndarray) -> np.ndarray:
        """The lists that each query looks into."""
        distance = (self.centres**2).sum(1) - 2 * (queries @ self.centres.T)
        return np.argsort(distance, axis=1, kind="stable")[:, : self.probes]


def fit(
    vectors: DataFrame, recall: float = 0.97, top: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", rows: int = FIT_ROWS, seed: int = 42
) -> Model:
    """A model from at most ``rows`` rows, those of the least seeded hash. The lists to look into are the fewest in which the sample's rows find this
    share of their ``top`` nearest in the sample.
    """
    width, n = _width(vectors, vector_col), vectors.count()
    sample = vectors.select(F.col(vector_col).alias("v")).orderBy(F.xxhash64(F.lit(seed), F.col(id_col))).limit(rows).toArrow()
    x = matrix(sample.column("v"), width)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        x = np.zeros((1, width))
    rng = np.random.default_rng(seed)
    centres = _kmeans(x, max(1, min(n // LIST_ROWS, MOST_LISTS, len(x) // 32)), rng)
    rest = x - centres[_closest(x, centres)]
    values = [_kmeans(rest[:, k : k + PIECE], min(VALUES, len(x)), rng) for k in range(0, width, PIECE)]
    asked = x[rng.permutation(len(x))[:500]]
    scores = asked @ x.T
    near = np.argsort(-scores, axis=1, kind="stable")[:, 1 : top + 1]
    every = Model(width, centres, values, len(centres))
    place = np.argsort(every.lists(asked), axis=1)  # of each list in a query's order
    places = np.take_along_axis(place, _closest(x, centres)[near], axis=1) if near.size else np.zeros((1, 1), int)
    return dataclasses.replace(every, probes=int(np.quantile(places, recall, method="higher")) + 1)


def index(vectors: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(list, neighbour, code): every row, written by the model."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, codes = model.encode(matrix(batch.column(1), model.width))
            yield pa.record_batch([pa.array(lists, pa.int32()), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "neighbour", "code"])

    return vectors.select(id_col, vector_col).mapInArrow(run, f"list int, neighbour {kind}, code binary")


def candidates(indexed: DataFrame, queries: DataFrame, model: Model, refine: int, id_col: str = "vec_id", vector_col: str = "embedding", part_rows: int = PART_ROWS) -> DataFrame:
    """(query, neighbour): the ``refine`` rows of an index that score best by their written vectors, for each query."""
    kind = indexed.schema["neighbour"].dataType.simpleString()
    sizes = indexed.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))  # at most MOST_LISTS rows

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = model.lists(matrix(batch.column(1), model.width))
            yield pa.record_batch([*batch.columns, pa.array(list(lists.astype(np.int32)), pa.list_(pa.int32()))], ["query", "qv", "block", "lists"])

    dealt, blocks = _blocks(queries.select(F.col(id_col).alias("query"), F.col(vector_col).cast("array<double>").alias("qv")), queries.count())
    asked = dealt.mapInArrow(probe, f"query {kind}, qv array<double>, block int, lists array<int>").withColumn("list", F.explode("lists")).drop("lists")
    asked = asked.join(F.broadcast(sizes), "list").withColumn("part", _each(F.col("parts"))).drop("parts")
    rows = indexed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("neighbour"), F.col("parts")).cast("int")).drop("parts")
    rows = rows.withColumn("block", _each(blocks))

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, names = rows.column("neighbour").combine_chunks(), queries.column("query").combine_chunks()
        if not len(ids) or not len(names):
            return pa.table({"query": names.slice(0, 0), "neighbour": ids.slice(0, 0), "score": pa.array([], pa.float64())})
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        scores = matrix(queries.column("qv"), model.width) @ model.decode(rows.column("list")[0].as_py(), codes).T
        q, r = _best(scores, np.equal.outer(np.asarray(names), np.asarray(ids)), refine)
        return pa.table({"query": names.take(pa.array(q)), "neighbour": ids.take(pa.array(r)), "score": pa.array(scores[q, r])})

    met = _met(rows, asked, ["list", "part", "block"], run, f"query {kind}, neighbour {kind}, score double")
    return _ranked(met, refine).select("query", "neighbour")


def search(
    vectors: DataFrame, queries: DataFrame, top: int = 10, refine: int = 40, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding",
    model: Model | None = None, part_rows: int = PART_ROWS,
) -> DataFrame:
    """(query, neighbour, score, rank): the best ``top`` other rows of each query by cosine, as the index finds them."""
    model = model or fit(vectors, recall, top, id_col, vector_col)
    indexed = stored(index(vectors, model, id_col, vector_col))
    near = candidates(indexed, queries, model, refine, id_col, vector_col, part_rows)
    a = queries.select(F.col(id_col).alias("query"), F.col(vector_col).alias("qv"))
    b = vectors.select(F.col(id_col).alias("neighbour"), F.col(vector_col).alias("v"))
    kind = vectors.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = matrix(batch.column(2), model.width), matrix(batch.column(3), model.width)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.round((x * y).sum(axis=1), 9) + 0.0)], ["query", "neighbour", "score"])

    met = near.join(b, "neighbour").join(a, "query").select("query", "neighbour", "qv", "v")
    return _ranked(met.mapInArrow(score, f"query {kind}, neighbour {kind}, score double"), top)


def _best_in_lists(x: np.ndarray, look: np.ndarray, y: np.ndarray, lists: list[tuple[int, int]], top: int) -> np.ndarray:
    """Numbers of the ``top`` rows of ``y`` that score best with each row of ``x``, -1 where there are fewer. lists: first row and end of each list;
    look: which of them a query looks into.
    """
    best, at = np.full((len(x), top), -np.inf, np.float32), np.full((len(x), top), -1)
    for k, (start, end) in enumerate(lists):
        asked = np.flatnonzero(look[:, k])
        for s in range(start, end if len(asked) else start, PART_ROWS):
            scores = x[asked] @ y[s : min(s + PART_ROWS, end)].T
            least = best[asked].min(axis=1)
            if scores.shape[1] >= top and np.isinf(least).any():  # the least of the greatest of ``top`` groups of rows is in no case above the last of the best
                groups = np.maximum.reduceat(scores, np.arange(top) * scores.shape[1] // top, axis=1).min(axis=1)
                least = np.maximum(least, np.nextafter(groups, np.float32(-np.inf)))
            q, r = np.divmod(np.flatnonzero(scores > least[:, None]), scores.shape[1])
            if not len(q):
                continue
            some, q = np.unique(q, return_inverse=True)
            counts = np.bincount(q)
            place = top + np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)
            found, number = np.full((len(some), top + counts.max()), -np.inf, np.float32), np.full((len(some), top + counts.max()), -1)
            found[:, :top], number[:, :top] = best[asked[some]], at[asked[some]]
            found[q, place], number[q, place] = scores[some[q], r], s + r
            kept = np.argpartition(-found, top - 1, axis=1)[:, :top]
            best[asked[some]], at[asked[some]] = np.take_along_axis(found, kept, axis=1), np.take_along_axis(number, kept, axis=1)
    return at


def neighbours_of_all(vectors: DataFrame, model: Model, top: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, near, score): for each row with a direction, its best ``top`` other rows by cosine in the lists it looks into, best first. Only
    scores above zero count. Vectors are compared in single precision; of rows that tie for the last place, any may be taken.
    """
    kind = vectors.schema[id_col].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), model.width)
            has = np.flatnonzero(np.linalg.norm(x, axis=1) > 0)
            x = x[has]
            lists = pa.array(_closest(x, model.centres), pa.int32())
            yield pa.record_batch([batch.column(0).take(pa.array(has)), lists, pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], ["id", "list", "v"])

    rows = stored(vectors.select(id_col, vector_col).mapInArrow(write, f"id {kind}, list int, v binary"))
    sizes = sorted(tuple(r) for r in rows.groupBy("list").count().collect())  # at most MOST_LISTS
    n, part_rows, block_rows = sum(c for _, c in sizes), max(1, PART_SIZE // model.width), max(1, BLOCK_SIZE // model.width)
    # lists one after another are cut into parts of equal numbers of rows; a list on a cut is dealt to its parts by hash
    parts, blocks, before, dealt = max(1, -(-n // part_rows)), max(1, -(-n // block_rows), min(8, n // TILE)), 0, []
    for number, count in sizes:
        first = before * parts // n
        before += count
        dealt.append((number, first, (before - 1) * parts // n - first + 1))
    held = {number: range(first, first + some) for number, first, some in dealt}
    places = F.broadcast(vectors.sparkSession.createDataFrame(dealt, "list int, first int, parts int"))
    placed = rows.join(places, "list").select("id", "list", "v", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part"))
    queries = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, model.width)
            asked = [sorted({p for k in line for p in held.get(k, ())}) for line in model.lists(x).tolist()]
            yield pa.record_batch([*batch.columns, pa.array(asked, pa.list_(pa.int32()))], ["id", "v", "block", "parts"])

    asked = queries.select("id", "v", "block").mapInArrow(asks, f"id {kind}, v binary, block int, parts array<int>")
    asked = asked.select("id", "v", "block", F.explode("parts").alias("part"))

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        rows, queries = rows.sort_by([("list", "ascending"), ("id", "ascending")]), queries.sort_by("id")
        ids, names = rows.column("id").combine_chunks(), queries.column("id").combine_chunks()
        x, y = (np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(-1, model.width) for t in (queries, rows))
        numbers, starts = np.unique(np.asarray(rows.column("list")), return_index=True)
        lists = list(zip(starts.tolist(), [*starts[1:].tolist(), len(ids)]))
        out = []
        for k in range(0, len(x) if len(y) else 0, TILE):
            some = x[k : k + TILE]
            looked = model.lists(some)
            look = np.zeros((len(some), len(model.centres)), bool)
            np.put_along_axis(look, looked, True, axis=1)
            at = _best_in_lists(some, look[:, numbers], y, lists, top + 1)  # the row itself may be among them
            q, place = np.nonzero(at >= 0)
            r = at[q, place]
            scores = np.round(np.einsum("ij,ij->i", some[q].astype(float), y[r].astype(float)), 7)
            own = np.asarray(pc.equal(names.take(pa.array(k + q)), ids.take(pa.array(r))))
            good = ~own & (scores > 0)
            q, r, scores = q[good], r[good], scores[good]
            order = np.lexsort((r, -scores, q))
            q, r, scores = q[order], r[order], scores[order]
            counts = np.bincount(q, minlength=len(some))
            first = np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts) < top
            q, r, scores = q[first], r[first], scores[first]
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(q, minlength=len(some)))]), pa.int32())
            near = pa.ListArray.from_arrays(ends, ids.take(pa.array(r)))
            out.append(pa.table([names.slice(k, TILE), near, pa.ListArray.from_arrays(ends, pa.array(scores, pa.float32()))], names=["id", "near", "score"]))
        return pa.concat_tables(out) if out else pa.table([names.slice(0, 0), pa.array([], pa.list_(ids.type)), pa.array([], pa.list_(pa.float32()))], names=["id", "near", "score"])

    met = _met(placed.withColumn("block", _each(blocks)), asked, ["part", "block"], run, f"id {kind}, near array<{kind}>, score array<float>")
    # numbers and scores travel as arrays and are paired only after the shuffle
    found = met.groupBy("id").agg(F.collect_list(F.struct("near", "score")).alias("found"))
    pairs = F.flatten(F.transform("found", lambda f: F.zip_with(f["score"], f["near"], lambda s, i: F.struct((-s).alias("less"), i.alias("near")))))
    found = found.select("id", F.slice(F.array_sort(pairs), 1, top).alias("found")).where(F.size("found") > 0)
    return found.select("id", F.col("found.near").alias("near"), F.transform("found.less", lambda s: -s).alias("score"))
