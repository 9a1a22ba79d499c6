"""Substrings, decontamination, quality and sharding against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from cadenza.llm import decontaminate, quality, sharding, substrings
from cadenza.llm.fmindex import FMIndex, suffix_order

SPACE = r"[^\x20\x09-\x0D]+"


def passages(seed=0):
    rng = np.random.default_rng(seed)
    draw = lambda n: " ".join(rng.choice([f"w{i}" for i in range(300)], n))
    shared, other = draw(70), draw(50)
    texts = [
        shared + " " + draw(20), draw(15) + "\n" + shared + "\t" + draw(9), draw(10) + " " + other, other, draw(30), None, "", " \n ", shared,
        draw(49), other + " " + shared + " " + other
    ]
    near = draw(200)
    return [*texts, near, near, near.replace(near.split()[90], "CHANGED"), "a " * 130, "a " * 70]


def brute_removed(texts, width=50):
    first, words = {}, [re.findall(SPACE, t or "") for t in texts]
    for i, w in enumerate(words):
        for s in range(len(w) - width + 1):
            first.setdefault(tuple(w[s : s + width]), i)
    out = []
    for i, w in enumerate(words):
        gone = {p for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] < i for p in range(s, s + width)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("anchor_segments", [2000, 0])
def test_substrings_against_brute_force(spark, anchor_segments):
    texts = passages()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, ord int, spans int")
    found = {
        r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.judge(docs, anchor_segments=anchor_segments, shard_words=300).collect()
    }
    assert [found[i] for i in range(len(texts))] == brute_removed(texts)
    assert sum(x[1] for x in found.values()) > 200


def test_substrings_pass_columns_through_and_take_empty_tables(spark):
    texts = passages(4)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, _spans string")
    out = substrings.deduplicate(docs)
    assert out.schema == docs.schema
    want = brute_removed(texts)
    for r in out.collect():
        if want[r.doc_id][1]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2]
        else:
            assert r.text == texts[r.doc_id]
    assert substrings.judge(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (None, texts[0])], "doc_id long, text string")
    assert sorted((r.n_removed for r in substrings.judge(same).collect())) == [0, 0, 90]


def test_fm_index_counts_what_a_scan_counts():
    rng = np.random.default_rng(2)
    symbols = np.append(rng.integers(1, 4, 200), 0)
    index = FMIndex(symbols, np.zeros(len(symbols), np.int64))
    assert sorted(suffix_order(symbols).tolist()) == list(range(len(symbols)))
    doubled = np.concatenate([symbols, symbols])
    for _ in range(50):
        n, at = int(rng.integers(1, 8)), int(rng.integers(0, 190))
        pattern = symbols[at : at + n]
        low, high = np.array([0]), np.array([len(symbols)])
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        assert high[0] - low[0] == sum((doubled[i : i + n] == pattern).all() for i in range(len(symbols)))


def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            q = words(text)
            n = min(13, len(q))
            windows = {tuple(q[s : s + n]) for s in range(len(q) - n + 1)} if q else set()
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def test_contamination_against_brute_force(spark):
    rng = np.random.default_rng(5)
    draw = lambda n: [f"t{i}" for i in rng.integers(0, 80, n)]
    a, b, short = draw(30), draw(13), draw(4)
    items = [(10, " ".join(a)), (9, " ".join(b).upper()), (7, " ".join(short)), (6, None), (5, "..."), (10, " ".join(draw(20)))]
    docs = [
        (1, " ".join(draw(40) + a[3:20] + draw(60))), (2, ", ".join(b)), (3, " ".join(draw(500))), (4, None), (5, ""), (6, " ".join(a + b + short)),
        (7, " ".join(a[:12])), (8, "é " + " ".join(short) + " ü"), (9, " ".join(draw(900) + b))
    ]
    found = decontaminate.judge(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found.collect()} == brute_contamination(docs, items)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    clean = decontaminate.remove(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, x in brute_contamination(docs, items).items() if not x[3]}
    assert decontaminate.judge(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.judge(frame, spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_proximity_finds_words_out_of_order(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "x y z alpha q beta r gamma z z"), (2, "alpha " + "f " * 40 + "beta gamma"), (3, "gamma beta alpha")], "doc_id long, text string"
    )
    decontaminate.build_index(docs.coalesce(1), f"{tmp_path}/i")
    near = decontaminate.search(spark, f"{tmp_path}/i", spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"), slop=4)
    assert sorted(r.k for r in near.collect()) == [0, 2]


def brute_near(docs, items, window, slop):
    """(text, item, place): places of a window's rarest term (over all texts; the first of equals) with the other terms near, in the same text."""
    words = [re.findall("[a-z0-9]+", t) for t in docs]
    counts, out = Counter(w for ws in words for w in ws), set()
    for name, text in items:
        terms = text.split()
        width = min(window, len(terms))
        for s in range(len(terms) - width + 1):
            phrase = terms[s : s + width]
            rarest = min(phrase, key=lambda w: counts[w])
            for d, ws in enumerate(words):
                for p, w in enumerate(ws):
                    if w == rarest and all(x in ws[max(0, p - width - slop) : p + width + slop + 1] for x in phrase):
                        out.add((d, name, p))
    return out


def test_proximity_and_phrases_against_brute_force_in_one_block_or_many(spark, tmp_path):
    rng = np.random.default_rng(12)
    draw = lambda n: " ".join(f"t{i}" for i in (rng.random(n) ** 2 * 60).astype(int))
    docs = [draw(int(rng.integers(1, 120))) for _ in range(60)]
    items = [(i, draw(int(rng.integers(1, 9)))) for i in range(25)] + [(30 + n, draw(n)) for n in (10, 11, 12, 13, 14, 20, 23, 24, 31)]
    decontaminate.build_index(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1), f"{tmp_path}/i")
    # ids of any type name the items
    frame = spark.createDataFrame(items, "item_id int, text string").withColumn("item_id", F.col("item_id").cast("smallint"))
    for block_words in (10, 1 << 20):
        near = decontaminate.search(spark, f"{tmp_path}/i", frame, window=4, slop=3, block_words=block_words)
        got = {(r.k, r["item"], r.at + j) for r in near.collect() for j in range(r.length)}
        assert got == brute_near(docs, items, 4, 3)
        exact = decontaminate.search(spark, f"{tmp_path}/i", frame, window=4, block_words=block_words)
        covered = {(r.k, r["item"], r.at + j) for r in exact.collect() for j in range(r.length)}
        want = set()
        for name, text in items:
            terms = text.split()
            width = min(4, len(terms))
            grams = {tuple(terms[s : s + width]) for s in range(len(terms) - width + 1)}
            for d, ws in enumerate(x.split() for x in docs):
                want |= {(d, name, p + j) for p in range(len(ws) - width + 1) if tuple(ws[p : p + width]) in grams for j in range(width)}
        assert covered == want


def test_contamination_of_long_and_repeated_texts_with_clashing_columns(spark):
    rng = np.random.default_rng(13)
    draw = lambda n: [f"t{i}" for i in rng.integers(0, 4000, n)]
    passage = draw(20)
    long = draw(300_000) + passage + draw(100)
    rows = [(1, " ".join(long)), (2, " ".join(passage)), (2, " ".join(passage)), (None, " ".join(passage + draw(5)))]
    docs = spark.createDataFrame([(i, t, "own", 0, "own") for i, t in rows], "doc_id long, text string, item string, k int, shard string")
    items = spark.createDataFrame([(5, " ".join(passage), "own")], "item_id long, text string, doc_id string")
    found = sorted(((r.id, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.judge(docs, items).collect()), key=str)
    assert found == [(1, 300_120, 20, False), (2, 20, 20, True), (2, 20, 20, True), (None, 25, 20, True)]
    left = decontaminate.remove(docs, items)
    assert [r.doc_id for r in left.collect()] == [1] and left.columns == docs.columns


def test_quality_cascade_does_not_depend_on_order(spark):
    rng = np.random.default_rng(6)
    prose = " ".join("w" * int(n) for n in rng.integers(3, 9, 120)) + "."
    prose = " ".join(f"{w}{i}" for i, w in enumerate(prose.split()))
    rows = [
        (1, prose), (2, None), (3, ""), (4, "few words only"), (5, "same old thing " * 40), (6, " ".join(w + "$$$" for w in prose.split())),
        (7, " ".join(w.upper() + "!!" for w in prose.split())), (8, "\n".join(["one line again"] * 3) + "\n" + prose), (9, "x" * 200_000)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.id: r for r in quality.judge(docs).collect()}
    for i, t in rows:
        w = re.findall(SPACE, t or "")
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeats = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(SPACE, x)]
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeats)
        ), i
        assert r.base_failed == (len(w) < 50 or 100 * len(repeats) > 50 * len(w))
    assert [i for i, r in sorted(found.items()) if r.kept] == [1, 8]
    rules = quality.BASE_RULES + quality.RULES
    for order in (rules, rules[::-1]):
        assert sorted(r.doc_id for r in quality.keep(docs, rules=order).collect()) == [1, 8]
    assert quality.keep(docs).schema == docs.schema and quality.judge(docs.limit(0)).count() == 0


def test_shards_hold_rows_and_sources_in_proportion(spark):
    sources = ["hot"] * 500 + ["a"] * 80 + ["b"] * 24 + [None] * 16
    rows = [(i, None if i % 50 == 0 else f"text {i % 7} é", s, i) for i, s in enumerate(sources)] + [(3, "text 3 é", "hot", 0)]
    found = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string, shard int"), 8).collect()
    assert len(found) == len(rows)
    counts = Counter(r.shard for r in found)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for k in range(8):
        assert sorted(r.slot for r in found if r.shard == k) == list(range(counts[k]))
    for s, n in Counter(r[2] for r in rows).items():
        own = Counter(r.shard for r in found if r.source == s)
        assert all(abs(own[k] - n / 8) <= 2 for k in range(8)), (s, own)
    assert all(r.size == len((rows[r.id][1] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((rows[r.id][1] or "").encode()) for r in found)
    assert sharding.interleave(spark.createDataFrame([], "doc_id long, text string, source string"), 8).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    rows = [(i, f"t{i}", f"s{i % 3}", i * 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    sharding.write_shards(docs, f"{tmp_path}/s", 4)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted((r.doc_id, r.text, r.source, r.extra) for r in back.collect()) == rows and set(r._shard for r in back.collect()) == {0, 1, 2, 3}


def test_items_with_a_null_id_are_searched_and_not_named(spark):
    rng = np.random.default_rng(11)
    draw = lambda n: " ".join(f"t{i}" for i in rng.integers(0, 80, n))
    passage, named = draw(20), draw(20)
    docs = spark.createDataFrame([(1, draw(30) + " " + passage), (2, draw(50)), (3, passage + " " + named)], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (4, named)], "item_id long, text string")
    found = {r.id: (r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.judge(docs, items).collect()}
    assert found == {1: (20, [], True), 2: (0, [], False), 3: (40, ["4"], True)}
    assert [r.doc_id for r in decontaminate.remove(docs, items.where("item_id is null")).collect()] == [2]
    empty = spark.createDataFrame([(None, passage)], "item_id string, text string")
    assert decontaminate.judge(docs, empty).where("contaminated").count() == 2


def test_matching_statistics_against_brute_force(spark):
    rng = np.random.default_rng(31)
    draw = lambda n: rng.integers(0, 12, n).tolist()
    texts = [draw(int(rng.integers(1, 60))) for _ in range(12)]
    symbols = np.concatenate([np.array([*[x + 1 for x in t], 0]) for t in texts])
    owner = np.repeat(np.arange(12), [len(t) + 1 for t in texts])
    index = FMIndex(symbols, owner)
    patterns = [np.array([x + 1 for x in draw(40)]) for _ in range(5)] + [np.array([0, 99, 3])]
    for bound in (12, 5):
        found = index.matching_statistics(patterns, np.full(len(patterns), bound))
        for p, lengths in zip(patterns, found):
            own = {tuple(t[a:b]) for t in texts[:bound] for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
            want = [
                max(
                    (n for n in range(e + 2) if n == 0 or tuple(x - 1 for x in p[e + 1 - n : e + 1].tolist()) in own), default=0
                ) for e in range(len(p))
            ]
            assert lengths.tolist() == want


def test_documents_streamed_through_shards_report_intervals(spark):
    texts = [t or "" for t in passages(8)]
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    words = [re.findall(SPACE, t) for t in texts]
    queries = [" ".join(["own"] * 5 + words[0][3:68] + ["mine"] + words[3]), "nothing of it", ""]
    frame = spark.createDataFrame([(chr(97 + k), q) for k, q in enumerate(queries)] + [("z", None)], "doc_id string, text string")
    found = {(r.id, r.start, r.length) for r in substrings.matching_statistics(frame, corpus, least=30).collect()}
    grams = {tuple(w[s : s + 30]) for w in words for s in range(len(w) - 29)}
    want = set()
    for k, q in enumerate(queries):
        w = q.split()
        hit = sorted({p for s in range(len(w) - 29) if tuple(w[s : s + 30]) in grams for p in range(s, s + 30)})
        runs = [p for p in hit if p - 1 not in hit]
        want |= {(chr(97 + k), p, next(n for n in range(1, len(w) + 2) if p + n not in hit)) for p in runs}
    assert found == want and len(want) == 2
    assert substrings.matching_statistics(frame.limit(0), corpus).count() == 0 and substrings.matching_statistics(frame, corpus.limit(0)).count() == 0
