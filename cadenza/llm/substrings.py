"""Substring dedup with FM-indexes in shards.

A window is ``width`` consecutive words. Its anchor is the k-gram of least hash in it, so equal windows have equal anchors; consecutive windows
with one anchor are a segment. Segments whose anchor stands in one document only cannot repeat and stay where they are. Equal segments are
merged, with the least document kept and the fact whether others have it too; their texts go to the shard of their anchor. There an FM-index of
the shard is built, and every segment is streamed through it: backward search over the wavelet matrix gives for each window whether it
occurs in a document before a bound, and runs of windows that do come back as intervals, to the documents that have the segment.

An anchor with very many different segments (the edge of a passage that much of the corpus shares) would fill a shard by itself. Its segments
are taken apart into windows, equal windows are merged in the same way, and only windows of two documents or more go on.

Defined results: a null text is an empty one without words; a text shorter than a window loses nothing; a null id comes after all others;
documents that share an id do not remove from each other; empty tables give empty results; other columns are ignored, and deduplicate() passes
them through. Segments are told apart by the hashes of their anchor and of their words, 64 bits each; equal ones travel once and share what is
found for them. Within a shard, words are told apart by 64-bit hashes, and matches are found in the segments' words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .fmindex import FMIndex
from .shared import NOT_SPACE, Words, apply_groups, cut, map_batches, remove, shared_dir, slices, spread, table, window_hash

WIDTH, GRAM = 50, 8
#: Words of a shard on average, and different segments of one anchor beyond which they are taken apart into windows.
SHARD_WORDS, ANCHOR_SEGMENTS = 150_000, 2000
#: Hot anchors, of 8 bytes each, that are broadcast at most.
BROADCAST_ANCHORS = 100_000
_LAST = (1 << 63) - 1
#: Words that the search for anchors takes at once; a window's position must fit beside its hash.
_PIECE = 1 << 22


def _segments(words: Words, hashes: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor hash, content hash) of each segment; windows are numbered by their first word."""
    out = []
    of = words.texts()
    for begin in range(0, max(len(hashes) - width + 1, 0), _PIECE):
        h, t = hashes[begin : begin + _PIECE + width - 1], of[begin : begin + _PIECE + width - 1]
        grams = window_hash(h, gram)
        key = (grams & ~np.uint64(_PIECE * 2 - 1)) | np.arange(len(grams), dtype=np.uint64)
        span, reach = width - gram + 1, 1
        while 2 * reach <= span:
            key = np.minimum(key[:-reach], key[reach:])
            reach *= 2
        key = np.minimum(key[: len(h) - width + 1], key[span - reach : span - reach + len(h) - width + 1])
        windows = np.flatnonzero(t[width - 1 :] == t[: len(t) - width + 1])
        if not len(windows):
            continue
        anchor = (key[windows] & np.uint64(_PIECE * 2 - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)]))
        counts = np.diff(np.append(new, len(windows)))
        first = windows[new]
        content = window_hash(h, width)
        both = content[first] * np.uint64(3) + content[first + counts - 1] * np.uint64(5) + counts.astype(np.uint64)
        out.append((begin + first, counts, grams[anchor[new]], both))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, d) for d in (np.int64, np.int64, np.uint64, np.uint64))


_ROW = "anchor bigint, segment bigint, ord bigint, h bigint, start int, n int"
_NAMES = ["anchor", "segment", "ord", "h", "start", "n"]


def _segment_rows(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets, NOT_SPACE)
                first, n, anchor, content = _segments(words, words.hashes(), width, gram)
                of = np.searchsorted(words.first, first, "right") - 1
                keys = batch.select(["ord", "h"]).slice(i, j - i).take(pa.array(of))
                yield pa.record_batch(
                    [pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), keys.column(0), keys.column(1), pa.array(first - words.first[of], pa.int32()), pa.array(n, pa.int32())],
                    _NAMES
                )

    return map_batches(docs, run, _ROW)


def _asked(docs: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """What is asked of documents, by (ord, h): the text of a segment, or with ``apart`` the text of each of its windows, with the window's own
    hash as segment. Of rows that are equal in both, a task asks the first one.
    """
    lists = asked.groupBy("ord", "h").agg(F.collect_set(F.struct("anchor", "segment", "start", "n", "apart", "shared")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [k not in seen and not seen.add(k) for k in keys]
            batch = batch if all(new) else batch.filter(pa.array(new))
            lists_ = batch.column(3)
            for i, j, data, offsets in slices(batch.column(2)):
                words = Words(data, offsets, NOT_SPACE)
                part = lists_.slice(i, j - i)
                flat = part.flatten()
                text = np.repeat(np.arange(j - i), np.asarray(part.value_lengths()))
                anchor, segment, start, n, apart, shared = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(6))
                begin = words.first[text] + start
                apart, shared = apart.astype(bool), shared.astype(bool)
                whole = np.flatnonzero(~apart)
                raw = data.tobytes()
                every = np.repeat(np.flatnonzero(apart), n[apart])
                step = np.arange(len(every)) - np.repeat(np.cumsum(n[apart]) - n[apart], n[apart])
                content = window_hash(words.hashes(), width)[begin[every] + step].view(np.int64) if len(every) else np.zeros(0, np.int64)
                rows = np.concatenate([whole, every])
                first = np.concatenate([begin[whole], begin[every] + step])
                last = np.concatenate([begin[whole] + n[whole] + width - 2, begin[every] + step + width - 1])
                texts = [raw[x:y] for x, y in zip(words.starts[first].tolist(), words.ends[last].tolist())]
                keys = batch.select(["ord", "h"]).slice(i, j - i).take(pa.array(text[rows]))
                columns = [
                    pa.array(anchor[rows]), pa.array(np.concatenate([segment[whole], content])), keys.column(0), keys.column(1),
                    pa.array(np.concatenate([start[whole], start[every] + step]), pa.int32()),
                    pa.array(np.concatenate([n[whole], np.ones(len(every), n.dtype)]), pa.int32()), pa.array(apart[rows]), pa.array(shared[rows]),
                    pa.array(texts, pa.binary()),
                ]
                yield pa.record_batch(columns, [*_NAMES, "apart", "shared", "text"])

    joined = docs.join(lists, ["ord", "h"]).select("ord", "h", "text", "asked")
    return map_batches(joined, run, _ROW + ", apart boolean, shared boolean, text binary")


def _search(width: int):
    def run(shard: pa.Table) -> pa.Table:
        """One shard: builds its index, streams its segments through it."""
        texts = shard.column("text").combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        words = Words(data, offsets - offsets[0], NOT_SPACE)
        kinds, symbols = np.unique(words.hashes(), return_inverse=True)
        counts = words.counts()
        ends = np.cumsum(counts + 1) - 1  # of each segment among all symbols: its separator
        joined = np.zeros(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(joined), bool)
        inside[ends] = False
        joined[inside] = symbols + 1
        ords, owner = np.unique(shard.column("ord").to_numpy(), return_inverse=True)
        index = FMIndex(joined, np.repeat(owner, counts + 1))
        first, last = ends - counts, ends - width
        shared = np.flatnonzero(shard.column("shared").to_numpy().astype(bool))
        query, low, high = index.windows_found(
            np.concatenate([first, first[shared]]), np.concatenate([last, last[shared]]), np.concatenate([owner, owner[shared] + 1]), width
        )
        least = query < len(first)
        segment = np.where(least, query, np.append(shared, [0])[np.maximum(query - len(first), 0)] if len(shared) else query)
        picked = shard.select(["anchor", "segment", "ord"]).take(pa.array(segment))
        return pa.table(
            [*picked.columns, pa.array(least), pa.array(low - first[segment], pa.int32()), pa.array(high - first[segment], pa.int32())],
            names=["anchor", "segment", "least", "is_least", "low", "high"]
        )

    return run


def _merged(rows: DataFrame) -> DataFrame:
    """Equal segments as one row: the first document that has it, where it stands there, and the last document."""
    return rows.groupBy("anchor", "segment").agg(F.min(F.struct("ord", "h", "start", "n")).alias("rep"), F.max("ord").alias("last"))


def _ordered(docs: DataFrame, id_col: str, name: str = "ord") -> DataFrame:
    """docs with a further column, a number in the order of ids, null last. Integers are their own number, unless the one that stands for null is among them;
    that case, and ids of other types, are numbered by a sorted table of the distinct ids in the shared folder.
    """
    kind, id_ = docs.schema[id_col].dataType, docs[f"`{id_col}`"]
    integer = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if integer and (not isinstance(kind, T.LongType) or docs.where(id_ == _LAST).limit(1).count() == 0):
        return docs.withColumn(name, F.coalesce(id_.cast("bigint"), F.lit(_LAST)))
    folder, spark = shared_dir(docs.sparkSession), docs.sparkSession
    ids = docs.select(id_.alias("_id")).where("_id IS NOT NULL").distinct()
    ids = ids.repartitionByRange("_id").sortWithinPartitions("_id")
    ids.select("_id", F.monotonically_increasing_id().alias("_number")).write.parquet(folder)  # rises with partitions and rows
    numbers = spark.read.parquet(folder)
    joined = docs.join(numbers, id_ == numbers["_id"], "left")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.coalesce(numbers["_number"], F.lit(_LAST)).alias(name))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, ord, h): documents by their order, and by a hash of the text to tell those that share an id."""
    narrow = spread(docs).select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{text_col}`"], F.lit("")).alias("text"))
    return _ordered(narrow, "id").withColumn("h", F.xxhash64("text"))


def repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, anchor_segments: int = ANCHOR_SEGMENTS,
    shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(ord, h, spans): for each document with windows that also start in an earlier one, runs of their first words as (low, high) from 0."""
    return _repeats(_keyed(docs, id_col, text_col), width, gram, anchor_segments, shard_words)


def _repeats(
    keyed: DataFrame, width: int = WIDTH, gram: int = GRAM, anchor_segments: int = ANCHOR_SEGMENTS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    spark = keyed.sparkSession
    keyed = keyed.select("ord", "h", "text")
    path = shared_dir(spark)
    _segment_rows(keyed, width, gram).write.option("compression", "zstd").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    units = _merged(rows)
    anchors = units.groupBy("anchor").agg(
        F.min("rep.ord").alias("low"), F.max("last").alias("high"), F.count("*").alias("segments")
    ).where("high > low")
    units = cut(units.join(anchors.select("anchor", "segments"), "anchor"), rows.count() // 8)  # narrow rows: eight times as many to a file
    n_units = units.count()
    hot = units.where(F.col("segments") > anchor_segments).select("anchor").distinct()
    asked = units.where(F.col("segments") <= anchor_segments).select(
        "anchor", "segment", "rep.*", F.lit(False).alias("apart"), (F.col("last") > F.col("rep.ord")).alias("shared")
    )
    n_hot = hot.limit(BROADCAST_ANCHORS + 1).count()
    if n_hot:  # few, since each has many segments; sent to the rows if they are few enough, so that an anchor's rows stay where they are
        asked = asked.unionByName(
            rows.join(F.broadcast(hot) if n_hot <= BROADCAST_ANCHORS else hot, "anchor").withColumns({"apart": F.lit(True), "shared": F.lit(True)})
        )
    _asked(keyed, asked, width).write.option("compression", "zstd").parquet(f"{path}/asked")
    got = spark.read.parquet(f"{path}/asked")
    texts = got.where("not apart")
    if n_hot:
        windows = got.where("apart")
        apart = cut(
            _merged(windows).where(F.col("last") > F.col("rep.ord")).select("anchor", "segment", "rep.ord", "rep.h", "rep.start"), windows.count()
        )
        texts = texts.unionByName(windows.join(apart, ["anchor", "segment", "ord", "h", "start"]).select(texts.columns))
        rows = rows.unionByName(windows.select(_NAMES))
    total = texts.agg(F.sum(F.col("n") + (width - 1))).first()[0] or 0
    shards = max(1, total // shard_words)
    dealt = texts.select(
        F.pmod(F.when(F.col("apart"), F.xxhash64("anchor", "segment")).otherwise(F.col("anchor")), F.lit(shards)).alias("shard"), "anchor", "segment",
        "ord", "shared", "text"
    )
    found = apply_groups(dealt, "shard", _search(width), "anchor bigint, segment bigint, least bigint, is_least boolean, low int, high int")
    met = rows.join(found, ["anchor", "segment"]).where(
        F.when(F.col("is_least"), F.col("ord") == F.col("least")).otherwise(F.col("ord") > F.col("least"))
    )
    spans = met.groupBy("ord", "h").agg(
        F.collect_set(F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))).alias("spans")
    )
    spans = cut(spans, n_units)
    remove(spark, path)
    return spans


def _removal(batch: pa.RecordBatch, i: int, j: int, data: np.ndarray, offsets: np.ndarray, spans: pa.Array, width: int) -> tuple[Words, np.ndarray]:
    """The words of rows i to j and which of them are removed."""
    words = Words(data, offsets, NOT_SPACE)
    part = spans.slice(i, j - i)
    lengths = np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = part.flatten()
    text = np.repeat(np.arange(j - i), lengths)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, words.first[text] + flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), 1)
    np.add.at(change, words.first[text] + flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64) + width, -1)
    return words, np.cumsum(change[:-1]) > 0


def _kept_texts(words: Words, removed: np.ndarray) -> list[bytes]:
    """The words that stay, joined by single spaces, text by text."""
    lengths = np.where(removed, 0, words.ends - words.starts + 1)
    stops = np.concatenate([[0], np.cumsum(lengths)])
    of_byte = NOT_SPACE[words.data]
    stays = np.repeat(~removed, words.ends - words.starts)
    out = np.full(int(stops[-1]), 0x20, np.uint8)
    mask = np.ones(len(out), bool)
    mask[stops[1:][~removed] - 1] = False
    out[mask] = words.data[of_byte][stays]
    raw, bounds = out.tobytes(), stops[words.first]
    return [raw[x : max(x, y - 1)] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **options: int) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every document."""
    keyed = _keyed(docs, id_col, text_col)
    spans = _repeats(keyed, width, **options)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                words, removed = _removal(batch, i, j, data, offsets, batch.column(2), width)
                sums = np.concatenate([[0], np.cumsum(removed)])[words.first]
                digests = [hashlib.sha256(t).hexdigest() for t in _kept_texts(words, removed)]
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), pa.array(words.counts(), pa.int64()), pa.array(np.diff(sums), pa.int64()), pa.array(digests)],
                    ["id", "n_words", "n_removed", "kept_sha256"]
                )

    joined = keyed.join(spans, ["ord", "h"], "left").select("id", "text", "spans")
    return map_batches(joined, run, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **options: int) -> DataFrame:
    """docs with repeated words taken out of the texts that have any: what stays of such a text is joined by single spaces. Other texts, and
    all other columns, are unchanged.
    """
    spans = _repeats(_keyed(docs, id_col, text_col), width, **options)
    name = "_order_of_ids"
    while name in docs.columns:
        name += "_"
    ordered, text = _ordered(docs, id_col, name), F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    keys = spans.select(F.col("ord").alias("_ord"), F.col("h").alias("_h"), F.col("spans").alias("_spans"))
    joined = ordered.join(keys, (ordered[name] == keys["_ord"]) & (F.xxhash64(text) == keys["_h"]), "left")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans_ = batch.column(batch.num_columns - 1)
            for i, j, data, offsets in slices(batch.column(at)):
                words, removed = _removal(batch, i, j, data, offsets, spans_, width)
                has = np.diff(np.concatenate([[0], np.cumsum(removed)])[words.first]) > 0
                column = batch.column(at).slice(i, j - i).to_pylist()
                kept = _kept_texts(words, removed) if has.any() else column
                texts = [k.decode() if x else t for x, k, t in zip(has.tolist(), kept, column)]
                rest = [c.slice(i, j - i) for c in batch.columns[:-1]]
                rest[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.record_batch(rest, batch.schema.names[:-1])

    return map_batches(joined.select(*[docs[f"`{c}`"] for c in docs.columns], keys["_spans"].alias("_spans_of_repeats")), run, docs.schema)


def matching_statistics(
    docs: DataFrame, corpus: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = WIDTH, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """(id, shard, start, length): where documents match a corpus for ``least`` words or more, as maximal intervals of words from 0.

    Each shard of the corpus, a run of rows of about ``shard_words`` words, becomes one FM-index; every document is streamed through it, and
    backward search gives the longest match that ends at each of its words, up to 128 words (``least`` at most). Intervals cover the matches
    of ``least`` words or more; ``length`` is the interval's. For a set of documents that is small beside the corpus: each passes every shard,
    in blocks of bounded size. A document that is in the corpus matches itself.
    """
    if not 0 < least <= 128:
        raise ValueError("least must be from 1 to 128")
    spark = docs.sparkSession
    kind, arrow_kind = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    schema, folder = f"id {kind}, shard string, start bigint, length bigint", shared_dir(spark)
    spark.createDataFrame([], schema).write.parquet(folder)

    def blocks() -> Iterator[list[tuple[object, str]]]:
        block, size = [], 0
        for row in docs.select(docs[f"`{id_col}`"].alias("i"), docs[f"`{text_col}`"].alias("t")).where("t IS NOT NULL").toLocalIterator():
            block.append((row["i"], row["t"]))
            size += len(row["t"])
            if size >= _BLOCK_CHARS:
                yield block
                block, size = [], 0
        if block:
            yield block

    for block in blocks():
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashes = [Words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), NOT_SPACE).hashes() for _, t in sent.value]
            for batch in batches:
                for i, j, data, offsets in slices(batch.column(0), shard_words * 6):
                    words = Words(data, offsets, NOT_SPACE)
                    if not len(words):
                        continue
                    kinds, symbols = np.unique(words.hashes(), return_inverse=True)
                    ends = np.cumsum(words.counts() + 1) - 1
                    joined, inside = np.zeros(int(ends[-1]) + 1, np.int64), np.ones(int(ends[-1]) + 1, bool)
                    inside[ends] = False
                    joined[inside] = symbols + 1
                    index = FMIndex(joined, np.zeros(len(joined), np.int64))
                    numbers = []
                    for h in hashes:
                        at = np.minimum(np.searchsorted(kinds, h), len(kinds) - 1)
                        numbers.append(np.where(kinds[at] == h, at + 1, 0))
                    shard = f"{zlib.crc32(data.tobytes()):08x}-{len(data)}"
                    for (name, _), lengths in zip(sent.value, index.matching_statistics(numbers, np.ones(len(numbers), np.int64))):
                        long = np.flatnonzero(lengths >= least)
                        if len(long):
                            change = np.zeros(len(lengths) + 1, np.int64)
                            np.add.at(change, long - lengths[long] + 1, 1)
                            np.add.at(change, long + 1, -1)
                            edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]]).astype(np.int8)))
                            starts, stops = edges[::2], edges[1::2]
                            columns = [
                                pa.array([name] * len(starts), arrow_kind), pa.array([shard] * len(starts)), pa.array(starts),
                                pa.array(stops - starts)
                            ]
                            yield pa.record_batch(columns, ["id", "shard", "start", "length"])

        texts = corpus.select(corpus[f"`{text_col}`"].alias("text"))
        map_batches(spread(texts), run, schema).write.mode("append").parquet(folder)
        sent.destroy()
    return spark.read.schema(schema).parquet(folder)


#: Characters of documents that pass the shards at once.
_BLOCK_CHARS = 1 << 20


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: The contract's removal in SQL, for a table of documents.
REMOVED_SQL = r"""
sw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {source}),
swin AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM sw WHERE len(w) >= 50) AS x),
sbad AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY key) AS least FROM swin) AS y WHERE doc_id > least),
scov AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM sbad),
sword AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM sw),
skept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM sword ANTI JOIN scov USING (doc_id, p) GROUP BY doc_id),
sgone AS (SELECT doc_id, count(*) AS n FROM scov GROUP BY doc_id),
removed AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(kept, '') AS kept
            FROM sw LEFT JOIN skept USING (doc_id) LEFT JOIN sgone USING (doc_id))"""

QUERIES = {"op2_substrings": op2_substrings}
ORACLE_SQL = {
    "op2_substrings": f"WITH {REMOVED_SQL.format(source='documents')} SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM removed"
}
