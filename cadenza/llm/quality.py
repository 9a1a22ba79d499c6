"""Quality rules as a short-circuit cascade.

Each rule rejects texts by itself, so the verdict does not depend on the order; the order only decides how much work is done. Cost and
selectivity of every rule are estimated on a random sample of rows, and rules run by falling rejection per cost, each on what the ones before
it left over. Cost is time on the clock, so that the order, and with it which of several rules is named in rejected_by, may differ from run to
run.

Defined results: a null text is an empty one (no words, so it fails); an empty table gives an empty result; repeated rows are judged one by
one and alike; columns other than the ones named are ignored or, in keep(), passed through whatever their names are.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import NOT_SPACE, Words, covered, map_batches, prefix_hash, slices, span_hash, spread, table, window_hash

#: Rows, about, and bytes of one text at most, that the estimate of cost and selectivity reads. Verdicts do not depend on it.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES = 400, 1 << 20

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(0x41, 0x5B)))
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80
_BANG = np.isin(np.arange(256), list(b"!"))


class Texts:
    """A run of texts with the measures that rules read, each made when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def only(self, chosen: np.ndarray) -> Texts:
        if chosen.all():
            return self
        lengths = np.diff(self.offsets)
        return Texts(self.data[np.repeat(chosen, lengths)], np.concatenate([[0], np.cumsum(lengths[chosen])]))

    def _count(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    @cached_property
    def words(self) -> Words:
        return Words(self.data, self.offsets, NOT_SPACE)

    @cached_property
    def prefix(self) -> np.ndarray:
        return prefix_hash(self.data)

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.words.counts()

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._count((NOT_SPACE & _STARTS_CHARACTER)[self.data])

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._count(_SYMBOLS[self.data])

    @cached_property
    def n_bangs(self) -> np.ndarray:
        return self._count(_BANG[self.data])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._count(_UPPER[self.data])

    @cached_property
    def n_letters(self) -> np.ndarray:
        return self._count(_LETTER[self.data])

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([breaks, self.offsets[1:]]), kind="stable")
        text = np.searchsorted(breaks, self.offsets)  # line breaks before each text
        of = np.repeat(np.arange(len(self)), np.diff(text) + 1)
        worded = np.searchsorted(self.words.starts, ends) > np.searchsorted(self.words.starts, starts)
        of, h = of[worded], span_hash(self.prefix, starts[worded], ends[worded])
        order = np.lexsort((h, of))
        of, h = of[order], h[order]
        again = np.flatnonzero((h[1:] == h[:-1]) & (of[1:] == of[:-1])) + 1
        return np.bincount(of[again], minlength=len(self))

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        words = self.words
        h = window_hash(span_hash(self.prefix, words.starts, words.ends), 3)
        of = words.texts()
        within = np.flatnonzero(of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, np.int64)
        h, of_window = h[within], of[within]
        order = np.lexsort((h, of_window))
        same = (h[order][1:] == h[order][:-1]) & (of_window[order][1:] == of_window[order][:-1])
        repeated = np.zeros(len(order), bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        return np.bincount(of[covered(within[order[repeated]], 3, len(of))], minlength=len(self))


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which ``rejects`` is true; ``sql`` says the same over the measures' names."""

    name: str
    rejects: Callable[[Texts], np.ndarray]
    sql: str


BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50, "n_words < 50"),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words, "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words, "10 * n_symbols > n_words"),
    Rule(
        "word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words),
        "word_chars < 2 * n_words OR word_chars > 20 * n_words"
    ),
    Rule("bangs", lambda t: 2 * t.n_bangs > t.n_words, "2 * n_bangs > n_words"),
    Rule("shouting", lambda t: (t.n_letters > 0) & (10 * t.n_upper > 7 * t.n_letters), "n_letters > 0 AND 10 * n_upper > 7 * n_letters"),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > t.n_words, "10 * n_dup_lines > n_words"),
)
#: Separators that stand as words of their own ("a | b | c") stay below one symbol in two words however many they are; prose has none in ten.
SEPARATORS = RULES[0]


def plan(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Orders rules by rejections per second on a seeded random sample of about ``sample_rows`` rows; without rows, as given.

    The rule with the most rejections per second comes first; then, each time, the one with the most among the rows that are left.
    """
    rules = tuple(dict.fromkeys(rules))
    share = min(1.0, sample_rows / max(1, docs.count()))
    short = docs.select(docs[f"`{text_col}`"].alias("text")).sample(False, share, 7)
    short = short.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES).toArrow()
    spent, parts = dict.fromkeys(rules, 1e-6), {rule: [np.zeros(0, bool)] for rule in rules}
    for _, _, data, offsets in slices(short.column("text")):
        for rule in rules:
            began = time.perf_counter()
            parts[rule].append(rule.rejects(Texts(data, offsets)))
            spent[rule] += time.perf_counter() - began
    rejects, left, ordered = {rule: np.concatenate(p) for rule, p in parts.items()}, np.ones(short.num_rows, bool), []
    while len(ordered) < len(rules):
        best = max((r for r in rules if r not in ordered), key=lambda rule: (rejects[rule] & left).sum() / spent[rule])
        ordered.append(best)
        left &= ~rejects[best]
    return ordered


def cascade(texts: Texts, rules: Sequence[Rule]) -> np.ndarray:
    """For each text the index of the rule that rejected it, or -1. Each rule sees only what is left."""
    verdict = np.full(len(texts), -1)
    left, rows = texts, np.arange(len(texts))
    for k, rule in enumerate(rules):
        if not len(rows):
            break
        out = rule.rejects(left)
        verdict[rows[out]] = k
        left, rows = left.only(~out), rows[~out]
    return verdict


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: Sequence[Rule] = BASE_RULES, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """(id, the five measures, base_failed, kept, rejected_by) of every row. Measures are of all texts; the rules beyond the base run as a
    cascade on those that pass it.
    """
    ordered = plan(docs, rules, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                texts = Texts(data, offsets)
                base_verdict = cascade(texts, base)
                passed = base_verdict < 0
                verdict = np.full(len(texts), -1)
                verdict[passed] = cascade(texts.only(passed), ordered)
                names = [base[b].name if b >= 0 else ordered[v].name if v >= 0 else None for b, v in zip(base_verdict, verdict)]
                columns = [
                    batch.column(0).slice(i, j - i), *(pa.array(getattr(texts, m), pa.int64()) for m in _MEASURES), pa.array(~passed),
                    pa.array(passed & (verdict < 0)), pa.array(names, pa.string())
                ]
                yield pa.record_batch(columns, ["id", *_MEASURES, "base_failed", "kept", "rejected_by"])

    schema = f"id {kind}, {', '.join(f'{m} bigint' for m in _MEASURES)}, base_failed boolean, kept boolean, rejected_by string"
    return map_batches(spread(docs).select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")), run, schema)


def keep(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BASE_RULES + RULES) -> DataFrame:
    """The rows whose text passes every rule, columns unchanged. One cascade over all rules, nothing measured beyond what it needs."""
    ordered, at = plan(docs, rules, text_col), docs.columns.index(text_col)
    docs = spread(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(cascade(Texts(data, offsets), ordered) < 0))

    return map_batches(docs, run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("rejected_by")


#: The measures and the verdict in SQL, for a table of texts.
MEASURES_SQL = r"""
texts AS (SELECT doc_id, coalesce(text, '') AS t FROM {source}),
worded AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM worded WHERE len(w) >= 3) AS x),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM windows, (SELECT unnest([0, 1, 2]) AS k) AS y WHERE n >= 2 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts),
dups AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM (SELECT doc_id, line, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line) AS z GROUP BY doc_id),
measures AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM worded LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id))"""
BASE_SQL = " OR ".join(f"({rule.sql})" for rule in BASE_RULES)
REJECT_SQL = " OR ".join(f"({rule.sql})" for rule in BASE_RULES + RULES)

QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL = {
    "op8_quality": f"""WITH {MEASURES_SQL.format(source="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_SQL}) AS base_failed, NOT ({REJECT_SQL}) AS kept FROM measures"""
}
