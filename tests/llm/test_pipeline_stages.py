"""Every stage of the pipeline, and all of it, against brute force over whole documents; and its edge cases."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from cadenza.llm import bpe, quality

from .test_near_duplicates import brute_groups
from .test_text_operators import SPACE, brute_contamination, brute_removed


def keeps(text):
    """The quality rules, by plain counting."""
    t = text or ""
    w = re.findall(SPACE, t)
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    many = {g for g, n in Counter(grams).items() if n > 1}
    repeats = {k + j for k, g in enumerate(grams) if g in many for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(SPACE, x)]
    letters, upper, chars = len(re.findall("[A-Za-z]", t)), len(re.findall("[A-Z]", t)), len("".join(w))
    bad = [
        len(w) < 50, 100 * len(repeats) > 50 * len(w), 10 * len(re.findall(r"[#*$%&|<>]", t)) > len(w), chars < 2 * len(w) or chars > 20 * len(w),
        2 * t.count("!") > len(w),
        letters > 0 and 10 * upper > 7 * letters, 10 * (len(lines) - len(set(lines))) > len(w),
    ]
    return not any(bad)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(re.findall(SPACE, text)))


def expected(documents, benchmark):
    """Each stage's (doc_id, text), one after another, from all pairs and plain dictionaries."""
    out = [[(i, t) for i, t in documents if keeps(t)]]
    _, groups = brute_groups([lowered(t) for _, t in out[-1]])
    names = {}
    for (i, _), g in zip(out[-1], groups):
        names[g] = min(names.get(g, i), i)
    out.append([(i, t) for (i, t), g in zip(out[-1], groups) if names[g] == i])
    kept = []
    rows = sorted(out[-1])
    words = [re.findall(SPACE, t) for _, t in rows]
    first = {}
    for k, w in enumerate(words):
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), k)
    for k, ((i, t), w) in enumerate(zip(rows, words)):
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s : s + 50])] < k for p in range(s, s + 50)}
        kept.append((i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t))
    assert [
        hashlib.sha256(" ".join(re.findall(SPACE, t)).encode()).hexdigest() for _, t in kept
    ] == [x[2] for x in brute_removed([t for _, t in rows])]
    out.append(kept)
    verdict = brute_contamination(kept, benchmark)
    out.append([(i, t) for i, t in kept if not verdict[i][3]])
    return out


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    documents = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    return documents, benchmark, expected(documents, benchmark)


def test_every_stage_is_what_brute_force_gives(spark, sf_dir, tables):
    documents, _, want = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for (name, stage), rows in zip(corpus_pipeline.STAGES, want):
        docs = stage(spark, docs, sf_dir).cache()
        assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows), name
        assert all(r.n_chars == len(r.text) for r in docs.select("n_chars", "text").collect())
    assert len(documents) > len(want[0]) > len(want[1]) and len(want[-1]) > 0


def test_the_whole_pipeline_gives_the_library_s_tokens_of_what_brute_force_keeps(spark, sf_dir, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in tables[2][-1]}
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {i: list(r.ids) for i, r in found.items()} == ids and all(r.n_tokens == len(ids[i]) for i, r in found.items())
    decoded = {i: hashlib.sha256(library.decode(x, skip_special_tokens=False).encode()).hexdigest() for i, x in ids.items()}
    assert {i: r.decoded_sha256 for i, r in found.items()} == decoded


def test_stages_take_nulls_repeated_rows_long_texts_clashing_columns_and_empty_tables(spark, sf_dir):
    prose = " ".join(f"Word{i} and{i % 7}" for i in range(60))
    long = " ".join(f"w{i}x" for i in range(60_000))
    rows = [(1, prose, "a"), (1, prose, "a"), (None, prose + " more", "b"), (3, None, "c"), (4, "", "d"), (5, long, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string").withColumnRenamed("component", "spans")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema == docs.schema and stage(spark, docs.limit(0), sf_dir).count() == 0, name
    assert sorted(str(r.doc_id) for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).collect()) == ["1", "1", "5", "None"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == ["1", "1", "3", "5", "None"]
    assert {r.n_tokens > 0 for r in corpus_pipeline.tokenization(spark, docs, sf_dir).where("doc_id = 5").collect()} == {True}
    assert corpus_pipeline.tokenization(spark, docs.limit(0), sf_dir).count() == 0


def test_quality_rules_are_those_that_the_brute_force_counts(spark):
    assert [r.name for r in quality.BASE_RULES + quality.RULES] == [
        "few_words", "repeated_words", "symbols", "word_length", "bangs", "shouting", "repeated_lines"
    ]
