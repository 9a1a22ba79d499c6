"""Benchmark decontamination on a positional inverted index that is stored in shards.

A shard is a run of training texts of about half a megabyte: its terms in order, and for each term the word positions at which it stands. Phrases
are searched in each shard from their rarest terms: the rarest term's positions, less its offset in the phrase, are candidate starts, and
each further term's positions, less its own offset, are intersected with what is left. All phrases of a block are searched together, and only
those of which a shard has every term. Test phrases travel to the shards in blocks of bounded size, so that a benchmark of any size works;
nothing of the corpus is sent to the driver.

Defined results: a null text has no words, and an item without words no windows; an item of fewer words than a window is one window; items
that share an id are one item of several texts; an item with a null id is searched like any other, only its name is never reported; repeated documents are judged one by one; empty tables give no
hits or an empty result; other columns are ignored, and remove() passes them through. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import ALNUM, Words, cut, map_batches, shared_dir, slices, spread, table, without
from .shared import remove as remove_folder

WINDOW = 13
#: Text bytes of a shard, unless a single text is longer.
SHARD_BYTES = 1 << 19
#: Bytes of a row group of the index: what a task reads at once.
GROUP_BYTES = 8 << 20
#: Words of test phrases that travel to the shards at once.
BLOCK_WORDS = 1 << 20

_SHARD = "shard string, ids array<{kind}>, first binary, n_words binary, terms binary, counts binary, steps binary"


def _postings(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms in order, positions of each term, their steps): positions rise within a term. Texts are one position apart, so no phrase crosses."""
    h = words.hashes()
    order = np.argsort(h, kind="stable")
    h = h[order]
    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    positions = (np.arange(len(h)) + words.texts())[order]
    steps = np.diff(positions, prepend=0)
    steps[begins] = positions[begins]
    return h[begins], np.diff(np.append(begins, len(h))), steps


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the index of all whole texts as Parquet, a row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1), SHARD_BYTES):
                words = Words(data, offsets, ALNUM, lower=True)
                terms, counts, steps = _postings(words)
                binary = [words.first[:-1] + np.arange(j - i), words.counts(), terms, counts.astype(np.uint32), steps.astype(np.uint32)]
                ids = batch.column(0).slice(i, j - i)
                yield pa.record_batch(
                    [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in binary)],
                    ["shard", "ids", "first", "n_words", "terms", "counts", "steps"]
                )

    schema = _SHARD.format(kind=docs.schema[id_col].dataType.simpleString())
    rows = map_batches(spread(docs).select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")), run, schema)
    rows.write.option("compression", "zstd").option("parquet.block.size", str(GROUP_BYTES)).parquet(path)


class Shard:
    """One shard's index in memory. ``keys`` holds each place of each term as (the term's row, position), in order."""

    def __init__(self, first: bytes, terms: bytes, counts: bytes, steps: bytes):
        self.first, self.terms = np.frombuffer(first, np.int64), np.frombuffer(terms, np.uint64)
        n, steps_ = np.frombuffer(counts, np.uint32).astype(np.int64), np.frombuffer(steps, np.uint32)
        self.ends = np.cumsum(n)
        self.begins = self.ends - n
        total = np.cumsum(steps_, dtype=np.int64)
        before = total[self.begins] - steps_[self.begins] if len(total) else total
        self.positions = total - np.repeat(before, n)
        self.keys = (np.repeat(np.arange(len(n)), n) << _POSITION_BITS) | self.positions

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's row, and in how many places it stands; none if it is absent."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        if not len(self.terms):
            return at, np.zeros(len(terms), np.int64)
        return at, np.where(self.terms[at] == terms, self.ends[at] - self.begins[at], 0)

    def _from_rarest(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For phrases as rows of terms' rows: (phrase, place) of the rarest term of each, and the order of each phrase's terms from the rarest on."""
        order = np.argsort(counts, axis=1, kind="stable")
        rarest = np.take_along_axis(rows, order[:, :1], axis=1)[:, 0]
        n = self.ends[rarest] - self.begins[rarest]
        phrase = np.repeat(np.arange(len(rows)), n)
        places = self.positions[np.arange(int(n.sum())) + np.repeat(self.begins[rarest] - (np.cumsum(n) - n), n)]
        return phrase, places, order

    def phrases(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of all exact occurrences: offset-adjusted places of the rarest terms, intersected with those of the next, and so on."""
        phrase, places, order = self._from_rarest(rows, counts)
        starts = places - order[phrase, 0]
        for k in range(1, rows.shape[1]):
            offset = order[phrase, k]
            wanted = (rows[phrase, offset] << _POSITION_BITS) | np.maximum(starts + offset, 0)
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            fine = (self.keys[at] == wanted) & (starts >= 0)
            phrase, starts = phrase[fine], starts[fine]
        return phrase[starts >= 0], starts[starts >= 0]

    def near(self, rows: np.ndarray, counts: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, place) of the rarest terms that have every other term of the phrase within ``reach`` words on either side, in the same text."""
        phrase, here, order = self._from_rarest(rows, counts)
        text = np.searchsorted(self.first, here, "right") - 1
        low = np.maximum(here - reach, self.first[text])
        ends = np.append(self.first[1:] - 1, _MOST_POSITION)
        high = np.minimum(here + reach + 1, ends[text])
        for k in range(1, rows.shape[1]):
            row = rows[phrase, order[phrase, k]] << _POSITION_BITS
            fine = np.searchsorted(self.keys, row | low) < np.searchsorted(self.keys, row | high)
            phrase, here, low, high = phrase[fine], here[fine], low[fine], high[fine]
        return phrase, here


#: A place is a number of so many bits, beside its term's row.
_POSITION_BITS = 32
_MOST_POSITION = (1 << _POSITION_BITS) - 1


class Block:
    """Test phrases of bounded size: their different terms, and their windows as numbers of terms, by width."""

    def __init__(self, hashes: list[np.ndarray], window: int):
        self.terms, number = np.unique(np.concatenate(hashes), return_inverse=True)
        number, ends = number.astype(np.int32), np.cumsum([len(h) for h in hashes])
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, (end, h) in enumerate(zip(ends.tolist(), hashes)):
            width = min(window, len(h))
            by_width.setdefault(width, []).append((item, np.lib.stride_tricks.sliding_window_view(number[end - len(h) : end], width)))
        self.windows = {
            w: (np.concatenate([m for _, m in found]), np.repeat([i for i, _ in found], [len(m) for _, m in found])) for w, found in by_width.items()
        }

    def matches(self, shard: Shard, slop: int | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(items, places, length) by width: different places at which windows of the items are found."""
        rows, counts = shard.find(self.terms)
        for width, (windows, items) in self.windows.items():
            left = np.arange(len(windows))
            for k in range(width):  # only windows of which every term stands somewhere in the shard
                left = left[counts[windows[left, k]] > 0]
            if not len(left):
                continue
            found = [self._searched(shard, rows, counts, windows, items, part, slop) for part in _parts(left, counts[windows[left]].min(axis=1))]
            both = np.unique(np.concatenate(found, axis=1), axis=1)
            if both.shape[1]:
                yield both[0], both[1], width if slop is None else 1

    @staticmethod
    def _searched(
        shard: Shard, rows: np.ndarray, counts: np.ndarray, windows: np.ndarray, items: np.ndarray, part: np.ndarray, slop: int | None
    ) -> np.ndarray:
        """Two rows, items and places, of the occurrences of some windows."""
        terms = windows[part]
        if slop is None:
            found, places = shard.phrases(rows[terms], counts[terms])
        else:
            found, places = shard.near(rows[terms], counts[terms], windows.shape[1] + slop)
        return np.stack([items[part[found]], places])


def _parts(windows: np.ndarray, rarest: np.ndarray) -> list[np.ndarray]:
    """Runs of windows whose rarest terms stand in about _PLACES places together, or of one window."""
    cuts = np.flatnonzero(np.diff(np.cumsum(rarest) // _PLACES)) + 1
    return np.split(windows, cuts)


#: Places of rarest terms that are searched from at once.
_PLACES = 1 << 16


def _item_blocks(
    items: DataFrame, id_col: str, text_col: str, window: int, block_words: int
) -> Iterator[list[tuple[object, np.ndarray]]]:
    """The test phrases as (item id, term hashes), in blocks of about ``block_words`` words; a longer item goes in parts that overlap, so that
    no window is cut. One partition of the items is on the driver at a time.
    """
    block, size = [], 0
    named = items.select(items[f"`{id_col}`"].alias("i"), items[f"`{text_col}`"].alias("t"))
    for row in named.where("t is not null").toLocalIterator():
        data = np.frombuffer(row["t"].encode(), np.uint8)
        hashes = Words(data, np.array([0, len(data)]), ALNUM, lower=True).hashes()
        for begin in range(0, len(hashes), block_words):
            part = hashes[begin : begin + block_words + window - 1]
            if begin and len(part) < window:  # its windows are all in the part before
                break
            block.append((row["i"], part))
            size += len(part)
            if size >= block_words:
                yield block
                block, size = [], 0
    if block:
        yield block


def search(
    spark: SparkSession, index: str, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
    slop: int | None = None, block_words: int = BLOCK_WORDS, folder: str | None = None,
) -> DataFrame:
    """(shard, k, item, at, length): matches of the items' windows in the indexed texts; k is the text's number in its shard, at its first word.

    Without slop, exact phrases; windows of an item that overlap in a text come as one stretch. With slop, proximity: places (length 1) of a
    window's rarest term that have all of its other terms, in any order, within window + slop words. Blocks are searched one after another,
    each in one pass over the index, and their matches written in ``folder`` (by default a new one of the shared folder), so that one block
    is in memory at a time.
    """
    kind, arrow_kind = items.schema[id_col].dataType.simpleString(), to_arrow_type(items.schema[id_col].dataType)
    folder = folder or shared_dir(spark)
    schema = f"shard string, k int, item {kind}, at bigint, length bigint"
    spark.createDataFrame([], schema).write.parquet(folder)
    for part in _item_blocks(items, id_col, text_col, window, block_words):
        block = spark.sparkContext.broadcast((Block([h for _, h in part], window), pa.array([i for i, _ in part], arrow_kind)))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            phrases, names = block.value
            for batch in batches:
                for row in range(batch.num_rows):
                    shard_id, *index_ = (c[row].as_py() for c in batch.columns)
                    shard = Shard(*index_)
                    for item, starts, length in phrases.matches(shard, slop):
                        new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (starts[1:] > starts[:-1] + length)]))
                        last = np.append(starts[new[1:] - 1], starts[-1])
                        at = starts[new]
                        k = np.searchsorted(shard.first, at, "right") - 1
                        columns = [
                            pa.array([shard_id] * len(at)), pa.array(k, pa.int32()), names.take(pa.array(item[new])),
                            pa.array(at - shard.first[k], pa.int64()), pa.array(last + length - at, pa.int64()),
                        ]
                        yield pa.record_batch(columns, ["shard", "k", "item", "at", "length"])

        map_batches(spark.read.parquet(index).select("shard", "first", "terms", "counts", "steps"), run, schema).write.mode("append").parquet(folder)
        block.destroy()
    return spark.read.schema(schema).parquet(folder)


def judge(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW
) -> DataFrame:
    """(id, n_words, n_hit, items, contaminated) of every document: hit words lie in an occurring window; contaminated from a twentieth of the
    words on.
    """
    spark = docs.sparkSession
    path, matches = shared_dir(spark), shared_dir(spark)
    build_index(docs, path, id_col, text_col)
    hits = search(spark, path, items, item_col, item_text_col, window, folder=matches)
    kind = docs.schema[id_col].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n = np.frombuffer(batch.column(2)[row].as_py(), np.int64)
                yield pa.record_batch(
                    [pa.array([batch.column(0)[row].as_py()] * len(n)), pa.array(np.arange(len(n)), pa.int32()), batch.column(1).slice(row, 1).flatten(), pa.array(n)],
                    ["shard", "k", "id", "n_words"]
                )

    all_texts = map_batches(spark.read.parquet(path).select("shard", "ids", "n_words"), texts, f"shard string, k int, id {kind}, n_words bigint")
    spans = F.array_sort(F.collect_list(F.struct("at", "length")))
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc, s):
        end = s["at"] + s["length"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(s["at"], acc["end"]), F.lit(0))).alias("n"))

    per_text = hits.groupBy("shard", "k").agg(spans.alias("spans"), F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    per_text = per_text.select("shard", "k", F.aggregate("spans", zero, step, lambda acc: acc["n"]).alias("n_hit"), "items")
    out = all_texts.join(per_text, ["shard", "k"], "left").select(
        "id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


    judged = cut(out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))), docs.count())
    for folder in (path, matches):
        remove_folder(spark, folder)
    return judged


def remove(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **names: str) -> DataFrame:
    """The documents that are not contaminated, columns unchanged. Documents that share an id go if one of them is contaminated."""
    bad = judge(docs, items, id_col, **names).where("contaminated").select("id")
    return without(docs, id_col, bad)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


#: The contract's verdict in SQL, for a table of documents.
JUDGE_SQL = r"""
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {source}),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
il AS (SELECT item_id, w, least(13, len(w)) AS n FROM iw WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS key FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM il) AS x),
dwin AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS key
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM il) AS y WHERE len(w) >= n) AS z),
hits AS (SELECT doc_id, s, n, item_id FROM dwin JOIN iwin USING (n, key)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) AS c GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) AS f GROUP BY doc_id),
judged AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
           FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id))"""

QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLE_SQL = {
    "op4_decontaminate": f"""WITH {JUDGE_SQL.format(source="documents")}
SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, contaminated FROM judged"""
}
