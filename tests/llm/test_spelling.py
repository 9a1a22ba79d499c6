"""Spelling variants against brute force, and their defined results."""

import random
import re
import zlib
from collections import Counter

import pytest

from cadenza.llm import spelling
from cadenza.llm.automaton import Automaton

WORD = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(docs, least=6):
    out = Counter()
    for id_, text in docs:
        for run in WORD.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            word = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
            out[word] += len(word) >= least
    return +out


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return out


def some_words(rng, n, letters="aabé×"):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(n)]


@pytest.mark.parametrize("shard_words, part_words", [(30_000, 10_000), (200, 8), (50, 1)])
def test_variants_against_brute_force(spark, shard_words, part_words):
    rng = random.Random(part_words)
    counts = {w: rng.choice([5, 6, 30, 900]) for w in some_words(rng, 220)}
    counts |= {"aaaaaa" + c: rng.choice([5, 60]) for c in "bcdefghijklmnopqrstuvwxyz"}  # one character apart, and all with one half
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = {tuple(r) for r in spelling.variants(words, shard_words=shard_words, part_words=part_words).collect()}
    assert got == plain_variants(counts)


def test_counts_and_noise_against_brute_force(spark):
    rng = random.Random(1)
    words = [*some_words(rng, 60, "abcÀÿZ"), "short", "Ünïcodé", "naïveté", "ĀbcdefgÉh", "x×y÷zab"]
    docs = [(k if k % 7 else None, " ".join(rng.choice(words) + rng.choice(["", ".", "1", "\n", "’", "Ł"]) for _ in range(60))) for k in range(200)]
    docs += [(5, None), (6, ""), (7, "abcdef" * 50_000), (8, "repeat repeat"), (8, "repeat repeat")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as n", "2 as word", "3 as id")
    got = {r["word"]: r["n"] for r in spelling.word_counts(frame, change=spelling.noisy).collect()}
    assert got == plain_counts(docs)
    plain = spelling.word_counts(frame).collect()
    assert sum(r["n"] for r in plain) > 0 and spelling.word_counts(frame.limit(0)).count() == 0
    assert spelling.variants(spark.createDataFrame([], "word string, n bigint")).count() == 0


def test_automata_number_words_and_are_minimal():
    rng = random.Random(2)
    words = sorted(set(some_words(rng, 400, "abc")))
    automaton = Automaton(words)
    for k, w in enumerate(words):
        state, number = automaton.walk(w)
        assert number == k and automaton.final[state]
        assert {words[x] for x in automaton.one_error(w, 3)} == {v for v in words if one_apart(w, v) and v[:3] == w[:3]}
    languages = set()
    for state in range(len(automaton.arcs)):
        stack, language = [(state, "")], set()
        while stack:
            s, text = stack.pop()
            if automaton.final[s]:
                language.add(text)
            stack += [(t, text + c) for c, (t, _) in automaton.arcs[s].items()]
        languages.add(frozenset(language))
    assert len(languages) == len(automaton.arcs)  # no two states accept the same
    assert Automaton([]).walk("a") is None
