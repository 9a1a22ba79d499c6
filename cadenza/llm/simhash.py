"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Defined results: a null text is an empty one; a text without words has fingerprint zero, which links like any other; repeated rows and
equal texts share a fingerprint and so a component; an empty table gives an empty result; columns other than the two named are ignored, so
their names cannot clash. A null id takes part in linking but never names a component unless all of its members are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import NOT_SPACE, Words, apply_groups, cut, map_batches, mix, remove, shared_dir, slices, spread, table, window_hash, without

#: A block's members are compared with each other up to this many; a fuller block's members go by one-bit neighbours, which is exact too.
BLOCK_MEMBERS = 32
#: Hashes whose bits are counted in one step.
_STEP = 1 << 17


def _fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    words = Words(data, offsets, NOT_SPACE, lower=True)
    counts, out = words.counts(), np.zeros(len(offsets) - 1, np.uint64)
    if not len(words):
        return out
    lengths = words.ends - words.starts
    stops = np.cumsum(lengths + 1) - 1  # of each word among the words joined by single spaces
    joined = np.full(int(stops[-1]) + 1, 0x20, np.uint8)
    at_word = np.ones(len(joined), bool)
    at_word[stops] = False
    joined[at_word] = words.data[NOT_SPACE[words.data]]
    joined = joined.tobytes()
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    of = np.repeat(np.arange(len(counts)), shingles)
    index = np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    first = words.first[of] + index
    last = np.minimum(first + width, words.first[of + 1]) - 1
    begin, end = (stops - lengths)[first], stops[last]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[x:y], 42) for x, y in zip(begin.tolist(), end.tolist())), np.uint64, len(of))
    return majority(h, shingles)


#: For each byte value, its bits as the bytes of an integer, so that one addition counts eight bits.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of hashes, of the lengths ``counts``: the integer whose bits are those set in over half the run; zero for an empty run."""
    ones = np.zeros((len(counts), 64), np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    cuts = np.flatnonzero(within % 255 == 0)  # a byte counts up to 255
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    for a in range(0, len(cuts), _STEP // 255 + 1):
        part = cuts[a : a + _STEP // 255 + 1]
        end = cuts[a + len(part)] if a + len(part) < len(cuts) else len(of)
        sums = np.add.reduceat(_SPREAD[lanes[part[0] : end]], part - part[0], axis=0)
        np.add.at(ones, of[part], sums.view(np.uint8).reshape(len(part), 64).astype(np.int64))
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of each whole text over word shingles, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(_fingerprints(data, offsets, width).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp bigint")


def _block_keys(distance: int, bits: int = 64) -> list[tuple[int, ...]]:
    """Masks: fingerprints within ``distance`` bits agree on one of these at least. distance + 2 blocks, of which two always agree."""
    blocks = distance + 2
    bounds = [bits * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    return [x | y for x, y in combinations(masks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def close_pairs(prints: DataFrame, distance: int = 2, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """Links (u, v) between distinct fingerprints of column fp: enough of them to give the same components as all pairs within ``distance``.

    Fingerprints are put into blocks; those that share a block are joined and the Hamming distance verified. Where a block holds more
    than ``block_members``, no pairs are made: each member lists itself with up to distance/2 bits flipped (65 values for distance 2),
    and members that list the same value are chained. Two members within 2 bits share such a value, and members that share one are
    within 2 bits, so this loses and adds nothing; a value is listed by 65 members at most, so no group is large.
    """
    if distance not in (1, 2):
        raise ValueError("distance must be 1 or 2")
    keys = F.explode(
        F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(_block_keys(distance))])
    ).alias("b")
    blocks = prints.select("fp", keys).select("fp", "b.t", "b.k")
    sizes = blocks.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(blocks.join(sizes, ["t", "k"]).select("t", "k", "fp", "n"), len(_block_keys(distance)) * prints.count())
    few = members.where(F.col("n") <= block_members)
    a, b = few.select("t", "k", F.col("fp").alias("u")), few.select("t", "k", F.col("fp").alias("v"))
    verified = a.join(b, ["t", "k"]).where("u < v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
    flips = F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("near")
    many = members.where(F.col("n") > block_members).select("fp").distinct()
    if distance == 1:  # values at distance one of each other meet in a value of one of them
        near = many.select("fp", flips)
        chained = near.join(many.select(F.col("fp").alias("near")), "near").where("fp < near").select(
            F.col("fp").alias("u"), F.col("near").alias("v")
        )
    else:
        lists = many.select("fp", flips).groupBy("near").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        chained = lists.select("u", F.explode("all").alias("v")).where("u <> v")
    return verified.unionByName(chained).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """One row per row of docs: id, fp (signed long), component: the least id reachable over links of at most ``distance`` bits.

    Equal fingerprints are merged before anything is linked, so exact copies cost one row however many they are.
    """
    n = docs.count()
    prints = cut(fingerprints(spread(docs), id_col, text_col, width))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least")), n)
    n = distinct.count()
    roots = components(close_pairs(distinct.select("fp"), distance), n)
    linked = distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", F.col("component").alias("linked"))
    component = cut(distinct.join(named, "fp", "left").select("fp", F.coalesce("linked", "least").alias("component")), n)
    return prints.join(component, "fp").select("id", "fp", "component")


#: Bits of the wide fingerprints, as so many 64-bit planes.
PLANES = 8
#: Candidates share a band: so many least hashes of their shingles. Two texts of similarity j miss each other with (1 - j ** rows) ** bands,
#: 3e-5 at 0.8.
BANDS, BAND_ROWS = 20, 4
#: A block's members are joined in pairs up to this many; a fuller block goes to tasks that compare all of up to twice TASK_MEMBERS.
SIMILAR_BLOCK_MEMBERS, TASK_MEMBERS = 64, 1 << 16
#: Of a group whose members are compared shingle by shingle, a task takes up to twice so many members and bytes of shingles, or two members.
EXACT_MEMBERS, EXACT_BYTES = 1 << 12, 8 << 20
#: Standard deviations of the Hamming distance that are allowed for, so that a pair at the very similarity passes 99.9 % of the time.
SPREAD = 3.0


def _plane_hashes(h: np.ndarray, plane: int) -> np.ndarray:
    return mix(h ^ np.uint64(0xA0761D6478BD642F * (plane + 1) % (1 << 64)))


_FACTORS = mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _bands(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For runs of hashes, of the lengths ``counts``: a key for each band, equal if the band's least hashes are; zero for an empty run."""
    out, hashes = np.zeros((len(counts), BANDS), np.uint64), mix(hashes)
    some = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[some]
    for k in range(BANDS * BAND_ROWS if len(some) else 0):
        least = np.minimum.reduceat((hashes ^ _FACTORS[k - 1]) * _FACTORS[k], starts)
        out[some, k // BAND_ROWS] = mix(out[some, k // BAND_ROWS] + least + np.uint64(k))
    return out


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text, in order, and how many each has. A text of fewer words has one shingle, all of its words."""
    words = Words(data, offsets, NOT_SPACE, lower=True)
    h, of, counts = words.hashes(), words.texts(), words.counts()
    runs = window_hash(h, width)
    inside = np.flatnonzero(of[width - 1 :] == of[: len(runs)]) if len(runs) else np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))  # as a sum that the words' order changes
    whole = [mix(np.cumsum(h[words.first[d] : words.first[d + 1]]).sum(keepdims=True))[0] for d in short.tolist()]
    hashes, of = np.concatenate([runs[inside], np.array(whole, np.uint64)]), np.concatenate([of[inside], short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, bool)
    return hashes[new], np.bincount(of[new], minlength=len(offsets) - 1)


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, planes: int = PLANES) -> DataFrame:
    """(id, key, b, s, shingles) of each whole text, over the set of its shingles of ``width`` words.

    key: a 128-bit hash of the set; b: the keys of its MinHash bands; s: its wide SimHash, as an array of longs; shingles: the set itself, as
    32-bit hashes in order.
    """

    def longs(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.view(np.int64).ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                hashes, n = _shingle_sets(data, offsets, width)
                ends = np.cumsum(n)
                keys = [xxhash.xxh3_128_digest(hashes[x:y].tobytes()) for x, y in zip((ends - n).tolist(), ends.tolist())]
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                sets = [short[x:y].tobytes() for x, y in zip((ends - n).tolist(), ends.tolist())]
                wide = np.stack([majority(_plane_hashes(hashes, p), n) for p in range(planes)], axis=1)
                columns = [
                    batch.column(0).slice(i, j - i), pa.array(keys, pa.binary()), longs(_bands(hashes, n)), longs(wide), pa.array(sets, pa.binary())
                ]
                yield pa.record_batch(columns, ["id", "key", "b", "s", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(texts, run, f"id {kind}, key binary, b array<bigint>, s array<bigint>, shingles binary")


def _distance(a: str, b: str, planes: int) -> Column:
    total = F.lit(0)
    for p in range(planes):
        total = total + F.bit_count(F.col(a)[p].bitwiseXOR(F.col(b)[p]))
    return total


def most_bits(similarity: float, planes: int = PLANES, spread: float = SPREAD) -> int:
    """The Hamming distance within which two sets of this Jaccard similarity lie, but for one in a thousand.

    Each bit differs with probability acos(2j / (1 + j)) / pi.
    """
    p, bits = np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi, 64 * planes
    return int(bits * p + spread * np.sqrt(bits * p * (1 - p)))


def spanning_links(prints: np.ndarray, most: int, alike: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up the same rows as all pairs of ``prints`` (rows of 64-bit planes) within ``most`` bits: one less than rows in each group.

    Walks from row to row and compares each with all that no link has reached yet, so that rows of one dense group cost little. With
    ``alike``, a pair must also pass alike(row, rows). Links go from the first row of a group to the others.
    """
    left, rest, us, vs = np.arange(len(prints)), prints, [], []
    while len(left):
        first, reached, left, rest = left[0], [left[0]], left[1:], rest[1:]
        while reached and len(left):
            at = reached.pop()
            near = np.bitwise_count(rest ^ prints[at]).sum(axis=1, dtype=np.int64) <= most
            if alike is not None and near.any():
                near[near] = alike(at, left[near])
            if near.any():
                found = left[near]
                reached += found.tolist()
                us.append(np.full(len(found), first))
                vs.append(found)
                left, rest = left[~near], rest[~near]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def jaccard_of(shingles: pa.Array, similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """alike(row, rows) for sets of 32-bit hashes in order: which rows have this Jaccard similarity to the row, or more."""
    offsets = np.frombuffer(shingles.buffers()[1], np.int32)[shingles.offset : shingles.offset + len(shingles) + 1].astype(np.int64) // 4
    flat = np.frombuffer(shingles.buffers()[2], np.uint8)
    flat = flat[: len(flat) // 4 * 4].view(np.uint32)
    sizes = np.diff(offsets)

    def alike(row: int, rows: np.ndarray) -> np.ndarray:
        own, mine = flat[offsets[row] : offsets[row + 1]], sizes[row]
        fits = np.minimum(sizes[rows], mine) >= similarity * np.maximum(sizes[rows], mine)
        for k in range(0, len(rows) if mine else 0, 1024):
            part = np.flatnonzero(fits[k : k + 1024]) + k
            if len(part):
                n = sizes[rows[part]]
                begins = np.cumsum(n) - n
                theirs = flat[np.arange(int(n.sum())) + np.repeat(offsets[rows[part]] - begins, n)]
                same = own[np.minimum(np.searchsorted(own, theirs), mine - 1)] == theirs
                common = np.add.reduceat(same, begins, dtype=np.int64)
                fits[part] = common >= similarity * (n + mine - common) - 1e-9
        return fits

    return alike


def _by_task(members: DataFrame, block: list[str], parts: Column) -> DataFrame:
    """Deals the members of each block to ``parts`` parts, and adds task, one for each two parts of a block, or for a block of one part."""
    mine, other = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = members.withColumn("parts", parts.cast("int")).withColumn("mine", mine).select("*", other).where("other <> mine or parts = 1")
    return dealt.withColumn(
        "task", F.struct(*block, F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    ).drop("parts", "mine", "other")


def _planes_of(task: pa.Table, planes: int) -> np.ndarray:
    return task.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, planes)


def _full_block_links(members: DataFrame, most: int, planes: int, task_members: int) -> DataFrame:
    """Links (u, v) of blocks (t, k, key, s, n) of any size. Each two members of a block meet in one task of at most about twice task_members."""
    tasks = _by_task(members, ["t", "k"], F.ceil(F.col("n") / task_members)).select("task", "key", "s")

    def run(task: pa.Table) -> pa.Table:
        keys = task.column("key").combine_chunks()
        u, v = spanning_links(_planes_of(task, planes), most)
        return pa.table({"u": keys.take(pa.array(u)), "v": keys.take(pa.array(v))})

    return apply_groups(tasks, "task", run, "u binary, v binary")


def candidate_links(
    prints: DataFrame, most: int, planes: int = PLANES, block_members: int = SIMILAR_BLOCK_MEMBERS, task_members: int = TASK_MEMBERS
) -> DataFrame:
    """Links (u, v) between rows (key, b, s): enough of them to give the same groups as all pairs that share a band and are within ``most`` bits.

    Whether two rows are compared depends on their own bands alone, not on the other rows: those of a band join in pairs, or in tasks of
    bounded size where they are more than ``block_members``.
    """
    rows = prints.select("key", F.posexplode("b").alias("t", "k"))
    sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(rows.join(sizes, ["t", "k"]), BANDS * prints.count())
    few = members.where(F.col("n") <= block_members)
    candidates = few.select("t", "k", F.col("key").alias("u")).join(
        few.select("t", "k", F.col("key").alias("v")), ["t", "k"]
    ).where("u < v").select("u", "v").distinct()
    left = prints.select(F.col("key").alias("u"), F.col("s").alias("su"))
    right = prints.select(F.col("key").alias("v"), F.col("s").alias("sv"))
    verified = candidates.join(left, "u").join(right, "v").where(_distance("su", "sv", planes) <= most).select("u", "v")
    full = members.where(F.col("n") > block_members).join(prints.select("key", "s"), "key")
    return verified.unionByName(_full_block_links(full, most, planes, task_members))


def similar_links(
    prints: DataFrame, similarity: float = 0.8, planes: int = PLANES, exact_members: int = EXACT_MEMBERS, exact_bytes: int = EXACT_BYTES,
    **blocks: int
) -> DataFrame:
    """Links (u, v) between rows (key, b, s, shingles), keys repeated or not: enough of them to give the groups of all pairs with this Jaccard
    similarity or more.

    Pairs that share a band and pass the Hamming check make rough groups; within each, pairs that pass the check are compared shingle by
    shingle. A member's shingles travel once, unless its group is more than a task takes; then each two parts of the group meet in a task.
    """
    most = most_bits(similarity, planes)
    once = cut(prints.groupBy("key").agg(F.first("b").alias("b"), F.first("s").alias("s")), prints.count())
    n = once.count()
    rough = components(candidate_links(once, most, planes, **blocks), n)
    rows = prints.join(rough.withColumnRenamed("node", "key"), "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("root", "s", "shingles")])
    rows = cut(rows)  # whole shingle sets: as many files as their bytes ask for
    sizes = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / exact_members, F.col("bytes") / exact_bytes))
    tasks = _by_task(rows.join(sizes, "root"), ["root"], F.least(parts, F.col("n"))).select("task", "key", "s", "shingles")

    def run(task: pa.Table) -> pa.Table:
        keys = task.column("key").combine_chunks()
        u, v = spanning_links(_planes_of(task, planes), most, jaccard_of(task.column("shingles").combine_chunks(), similarity))
        return pa.table({"u": keys.take(pa.array(u)), "v": keys.take(pa.array(v))})

    return apply_groups(tasks, "task", run, "u binary, v binary")


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, **options: int
) -> DataFrame:
    """(id, component): groups of texts linked by the Jaccard similarity of their sets of word shingles; component is the least id.

    Texts with equal sets are merged first, texts without words among them. A null id is named as a member and names no group unless all
    of its members are null; repeated rows are in one group; an empty table gives an empty result; other columns are ignored.
    """
    folder, n = shared_dir(docs.sparkSession), docs.count()
    wide_fingerprints(spread(docs), id_col, text_col, width).write.option("compression", "zstd").parquet(folder)
    prints = docs.sparkSession.read.parquet(folder)
    distinct = prints.groupBy("key").agg(F.min("id").alias("least"))
    roots = components(similar_links(prints, similarity, **options), n)
    linked = distinct.join(roots.withColumnRenamed("node", "key"), "key")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component")), "root").select("key", F.col("component").alias("linked"))
    component = distinct.join(named, "key", "left").select("key", F.coalesce("linked", "least").alias("component"))
    groups = cut(prints.select("id", "key").join(component, "key").select("id", "component"), n)
    remove(docs.sparkSession, folder)
    return groups


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, **options: int) -> DataFrame:
    """docs with one document of each group of near copies, the one of the least id; columns unchanged. Rows with a null id stay."""
    gone = similar_groups(docs, id_col, text_col, width, similarity, **options).where("id <> component").select("id")
    return without(docs, id_col, gone)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component. Blocks of up to BLOCK_MEMBERS fingerprints are joined and verified in pairs; fuller ones go
    by one-bit neighbours (see close_pairs), which gives the same components.
    """
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


QUERIES = {"op1_simhash": op1_simhash}
