r"""Spelling variant grouping: words that differ by one character, found in forward and backward automata.

Words are counted over all texts. If two words differ by one inserted, deleted or replaced character, then either the first half of one is the
beginning of the other, or its second half is the other's end. So each word is searched twice: in an automaton of the words, its first half is
matched exactly and the rest is completed with one error; in an automaton of the reversed words the same is done from the end. Word numbers of
the automata give the found words and their counts; what both directions find is taken once.

Automata are built for shards of the vocabulary. A word meets all that may be near it in the shard of its half: it is dealt there for each
word length that it may be near to, so shards need nothing from each other. Where very many words share a half, that part of them is dealt anew by
the same argument: the half that may hold the error is halved again, and either its beginning or its end is exact as well. In the end all but
one character is exact, so that no part stays large, whatever the words are; no pair is lost on the way.

A word's form is the near word that is most frequent, if it is at least ``ratio`` times as frequent as the word; the root is where following forms ends.

Defined results: a null text has no words; a null id is written as nothing before the colon of the noise; repeated rows count once each; ties
between forms go to the smaller word by code points; an empty table gives an empty result; further columns are ignored, whatever their names are.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Automaton
from .shared import LOWER, apply_groups, cut, map_batches, slices, spread, table

#: Code points and occurrences that a word has at least, and how many times more frequent its form is.
LEAST_CHARS, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a shard on average, and words of one part of the vocabulary beyond which it is dealt anew.
SHARD_WORDS, PART_WORDS = 30_000, 10_000
#: Shards that a task builds and searches on average, one after another.
SHARDS_A_TASK = 2
#: Parts, of some 40 bytes each, that are broadcast at most when they are dealt anew.
BROADCAST_PARTS = 50_000
#: Different words that a task counts before it hands them on.
TALLY = 200_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True  # U+00C0 to U+00FF are the byte C3 and one more


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions at which runs of [A-Za-z and U+00C0 to U+00FF] begin and end, and their lengths in code points."""
    inside = _LETTER[data]
    two = data == 0xC3
    inside[1:] |= two[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] & inside[:-1]
    edge[offsets] = False
    starts, ends = np.flatnonzero(inside & ~edge[:-1]), np.flatnonzero(inside & ~edge[1:]) + 1
    pairs = np.concatenate([[0], np.cumsum(two)])
    return starts, ends, ends - starts - (pairs[ends] - pairs[starts])


def noisy(run: bytes, seed: int) -> str:
    """A run, with a code point deleted if 199 divides the CRC-32 of what ``seed`` is the CRC-32 of, followed by the run."""
    text, h = run.decode(), zlib.crc32(run, seed)
    return text if h % 199 else text[: h % len(text)] + text[h % len(text) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[bytes, int], str] | None = None, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(word, n) of all texts: lower-cased runs of at least so many code points. change: what a run of a document becomes, from the run and
    the CRC-32 of its id and a colon; runs are counted as they are by default.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])
            tally.clear()
            return out

        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                starts, ends, chars = runs(data, offsets)
                raw = LOWER[data].tobytes()
                long = chars >= least_chars
                starts, ends = starts[long], ends[long]
                bounds = np.searchsorted(starts, offsets).tolist()
                words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
                for id_, a, b in zip(batch.column(0).slice(i, j - i).to_pylist(), bounds, bounds[1:]):
                    seed = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                    for word, n in Counter(words[a:b]).items():
                        text = word.decode() if change is None else change(word, seed)
                        if len(text) >= least_chars:
                            tally[text] += n
                    if len(tally) >= TALLY:
                        yield handed()
        yield handed()

    narrow = spread(docs).select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    return map_batches(narrow, run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _halved(rows: DataFrame) -> DataFrame:
    """rows (word, n, len, path, a, b), each as two: the first ``a`` and the last ``b`` characters of a word of length ``len`` are exact, and of the
    rest either the first half (path F) or the second half (B) becomes so.
    """
    half = F.floor((F.col("len") - F.col("a") - F.col("b")) / 2).cast("int")
    both = rows.withColumn("_half", half).select("*", F.explode(F.array(F.lit("F"), F.lit("B"))).alias("_step"))
    forward = F.col("_step") == "F"
    return both.select(
        "word", "n", "len", F.concat("path", "_step").alias("path"), F.when(forward, F.col("a") + F.col("_half")).otherwise(F.col("a")).alias("a"),
        F.when(forward, F.col("b")).otherwise(F.col("len") - F.col("a") - F.col("_half")).alias("b"),
    ).withColumn("part", F.xxhash64("path", "len", F.expr("left(word, a)"), F.expr("right(word, b)")))


def _parts(words: DataFrame, part_words: int) -> DataFrame:
    """words (word, n) dealt to parts of at most part_words words, but for parts in which all characters but one are exact. A word is in the parts of
    its own length, in which it is searched, and in those of the next shorter and longer ones.
    """
    length = F.char_length("word")
    lengths = F.explode(F.sequence(length - 1, length + 1))
    rows = _halved(words.select("word", "n", lengths.alias("len")).selectExpr("word", "n", "len", "'' as path", "0 as a", "0 as b"))
    out = []
    while True:
        large = cut(rows.groupBy("part").agg(F.count("*").alias("k")).where((F.col("k") > part_words)).select("part"))
        n = large.limit(BROADCAST_PARTS + 1).count()
        if not n:
            return _united([*out, rows])
        large = F.broadcast(large) if n <= BROADCAST_PARTS else large
        divisible = F.col("len") - F.col("a") - F.col("b") > 1
        marked = cut(rows.join(large.withColumn("is_large", F.lit(True)), "part", "left").withColumn("again", F.coalesce("is_large", F.lit(False)) & divisible))
        out.append(marked.where("not again").drop("is_large", "again"))
        rows = _halved(marked.where("again").drop("is_large", "again", "part"))
        if marked.where("again").limit(1).count() == 0:
            return _united(out)


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _search(shard: pa.Table) -> pa.Table:
    """Builds both automata of a shard, and searches its words in them."""
    found: dict[tuple[str, str], int] = {}
    words, counts = shard.column("word").to_pylist(), dict(zip(shard.column("word").to_pylist(), shard.column("n").to_pylist()))
    rows = list(zip(words, shard.column("is_forward").to_pylist(), shard.column("exact").to_pylist()))
    for forward in (True, False):
        turned = sorted({w if forward else w[::-1] for w, f, _ in rows if f == forward})
        automaton = Automaton(turned)
        for word, f, exact in rows:
            if f == forward and exact is not None:
                for number in automaton.one_error(word if forward else word[::-1], exact):
                    near = turned[number] if forward else turned[number][::-1]
                    found[word, near] = counts[near]
    return pa.table({
        "word": pa.array([w for w, _ in found], pa.string()), "near": pa.array([v for _, v in found], pa.string()),
        "near_n": pa.array(list(found.values()), pa.int64()),
    })


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """(word, near, near_n): all pairs of different words (word, n), either way round, that differ by one inserted, deleted or replaced character."""
    parts = _parts(words, part_words)
    shards = max(1, -(-words.count() * 6 // shard_words))
    own = F.char_length("word") == F.col("len")
    forward = F.col("path").endswith("F")
    dealt = parts.select(
        F.pmod("part", F.lit(shards)).alias("shard"), "word", "n", forward.alias("is_forward"),
        F.when(own, F.when(forward, F.col("a")).otherwise(F.col("b"))).alias("exact"),
    )
    dealt = dealt.repartition(max(1, shards // SHARDS_A_TASK), "shard")  # little data and much work: bytes are no measure of it
    return apply_groups(dealt, "shard", _search, "word string, near string, near_n bigint").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): forms are followed by doubling; each is more frequent than its word, so they end."""
    steps = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("_of"), F.col("root").alias("_root"))
        steps = cut(steps.join(ahead, steps["root"] == F.col("_of"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if steps.where("moved").limit(1).count() == 0:
            return steps.select("word", "root")
        steps = steps.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS, part_words: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n), each there once."""
    near = near_words(words, shard_words, part_words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(best, "word", "left")
    judged = judged.withColumn("is_form", -F.col("best.less") >= ratio * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("is_form"), F.col("best.near")).alias("form"),
        F.when(F.col("is_form"), -F.col("best.less")).alias("form_n"),
    )
    judged = cut(judged)
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, with the contract's noise, that is long and frequent enough; its form and root among them."""
    counted = word_counts(table(spark, sf_dir, "documents"), change=noisy)
    return variants(cut(counted.where(F.col("n") >= LEAST_COUNT)))


QUERIES = {"op12_spelling": op12_spelling}
ORACLE_SQL = {
    "op12_spelling": r"""WITH RECURSIVE
polynomial AS (SELECT list(v ORDER BY k) AS t FROM (
  SELECT k, list_reduce(list_prepend(CAST(k AS BIGINT), [CAST(0 AS BIGINT) FOR b IN range(8)]), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS k) AS x) AS y),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) AS x
  WHERE length(run) >= 6 GROUP BY doc_id, run),
coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS code FROM runs),
hashed AS (
  SELECT run, n, xor(CAST(4294967295 AS BIGINT), list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), [CAST('0x' || code[k:k + 1] AS BIGINT) FOR k IN range(1, length(code), 2)]),
    lambda crc, byte: xor(crc >> 8, t[(xor(crc, byte) & 255) + 1]))) AS h
  FROM coded, polynomial),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed) AS x
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
shorter AS (SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS s FROM (SELECT word, unnest(range(length(word))) AS k FROM words) AS x),
near AS (
  SELECT a.word, b.word AS near FROM shorter AS a JOIN shorter AS b ON a.k = b.k AND a.s = b.s AND a.word <> b.word
  UNION SELECT a.word, b.word FROM shorter AS a JOIN words AS b ON a.s = b.word
  UNION SELECT b.word, a.word FROM shorter AS a JOIN words AS b ON a.s = b.word),
ranked AS (SELECT x.word, x.near, w.n AS near_n, count(*) OVER (PARTITION BY x.word) AS n_near, row_number() OVER (PARTITION BY x.word ORDER BY w.n DESC, x.near) AS r
           FROM near AS x JOIN words AS w ON x.near = w.word),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
           FROM words AS w LEFT JOIN ranked AS r ON w.word = r.word AND r.r = 1),
chain AS (SELECT word, word AS root, 0 AS k FROM judged UNION ALL SELECT c.word, j.form, c.k + 1 FROM chain AS c JOIN judged AS j ON c.root = j.word WHERE j.form IS NOT NULL)
SELECT j.word, j.form, c.root, j.n, CAST(j.n_near AS BIGINT) AS n_near, j.form_n FROM judged AS j JOIN (SELECT word, max_by(root, k) AS root FROM chain GROUP BY word) AS c ON j.word = c.word"""
}
