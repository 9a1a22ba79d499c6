"""Suffix automata, shared shuffles, linear palindromes, section pairs and chained clustering against plain loops, and on long pieces."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from cadenza.operators import composition, forms, repeats
from tests.test_brute_force import plain_mirrors, plain_palindromes


def plain_repeats(values, least_length, least_support):
    places, n = {}, len(values)
    for i in range(n):
        for j in range(i + 1, n + 1):
            places.setdefault(tuple(values[i:j]), []).append(i)
    out = []
    for run, at in places.items():
        before = {values[i - 1] if i else ("begin", i) for i in at}
        after = {values[i + len(run)] if i + len(run) < n else ("end", i) for i in at}
        if len(run) >= least_length and len(at) >= least_support and (len(before) > 1 or len(at) == 1) and (len(after) > 1 or len(at) == 1):
            out.append((at[0], len(run), len(at)))
    return sorted(out)


def plain_ward(x, names):
    """By the update formula over all pairs."""
    sizes, label = dict.fromkeys(range(len(names)), 1), dict(enumerate(names))
    d = {(i, j): float(((x[i] - x[j]) ** 2).sum()) for i in range(len(x)) for j in range(i + 1, len(x))}
    out, new = [], len(names)
    while len(sizes) > 1:
        (i, j), least = min(d.items(), key=lambda e: (round(e[1], 9), e[0]))
        total = sizes[i] + sizes[j]
        out.append((len(out), label[i], label[j], float(np.sqrt(least)), total))
        for k in [k for k in sizes if k not in (i, j)]:
            a, b = d.pop((min(i, k), max(i, k))), d.pop((min(j, k), max(j, k)))
            d[(k, new)] = ((sizes[i] + sizes[k]) * a + (sizes[j] + sizes[k]) * b - sizes[k] * least) / (total + sizes[k])
        del d[(i, j)], sizes[i], sizes[j]
        sizes[new], label[new], new = total, f"#{len(out) - 1}", new + 1
    return out


def test_automaton_finds_the_maximal_repeats():
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.randrange(3) for _ in range(rng.randrange(1, 25))]
        assert repeats.repeats_of(values, 2, 2) == plain_repeats(values, 2, 2)
    assert repeats.repeats_of([], 1, 1) == []
    alike = repeats.repeats_of([7] * 50_000, 3, 2)
    assert len(alike) == 49_997 and alike[0] == (0, 3, 49_998)  # each length is one run more often than the next


def test_shared_shuffles_against_plain_counting(spark):
    rng = np.random.default_rng(4)
    notes = [(p, k, int(x)) for p in range(3) for k, x in enumerate(rng.integers(60, 63, 40))]
    got = {
        (r["piece_id"], r["length"], r["first_position"]): (r["support"], r["z"])
        for r in repeats.significance(spark.createDataFrame(notes, "piece_id long, seq int, pitch int"), 3, 5, 2, shuffles=6).collect()
    }
    want = {}
    for p in range(3):
        steps = np.diff([x for q, _, x in notes if q == p])
        for n in (3, 4, 5):
            runs = [tuple(steps[i : i + n].tolist()) for i in range(len(steps) - n + 1)]
            mixed_rng = np.random.default_rng([42, n])
            mixed = [mixed_rng.permutation(steps).tolist() for _ in range(6)]
            for run in sorted({r for r in runs if runs.count(r) >= 2}):
                counts = [sum(tuple(m[i : i + n]) == run for i in range(len(m) - n + 1)) for m in mixed]
                mean, deviation = np.mean(counts), np.std(counts)
                deviation = np.sqrt(mean + 1e-8) if deviation < 1e-6 else deviation
                want[p, n, runs.index(run)] = (runs.count(run), (runs.count(run) - mean) / deviation)
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_forms_of_random_pieces_against_plain_loops(spark):
    rng = random.Random(7)
    pieces = {p: [(rng.choice([60, 60, 62, 64]), rng.choice([1.0, 1.05, 2.0]), float(k)) for k in range(rng.randrange(1, 70))] for p in range(14)}
    notes = spark.createDataFrame([(p, k, *n) for p, ns in pieces.items() for k, n in enumerate(ns)], "piece_id long, seq int, pitch int, duration double, start double")
    got = sorted((r["piece_id"], r["kind"], r["start"], r["length"]) for r in forms.palindromes(notes).collect())
    assert got == sorted((p, *r) for p, ns in pieces.items() for r in plain_palindromes(ns))
    mirrors = sorted((r["piece_id"], r["a_start"], r["b_start"], r["length"], r["similarity"]) for r in forms.structural_mirrors(notes, threshold=0.75).collect())
    assert mirrors == sorted((p, *r) for p, ns in pieces.items() for r in plain_mirrors([n[0] for n in ns], 0.75))


@pytest.mark.parametrize("values", [1, 5])
def test_long_pieces_take_one_bounded_task(spark, values):
    rows = spark.range(50_000).selectExpr("1L as piece_id", "cast(id as int) as seq", f"cast(60 + pmod(hash(id), {values}) as int) as pitch", "1.0D as duration")
    begin = time.time()
    assert forms.palindromes(rows).count() > 15
    assert repeats.maximal_repeats(rows).count() > 1000
    assert time.time() - begin < 60


def test_chained_clustering_is_the_same_tree():
    rng = random.Random(3)
    for seed in range(25):
        x = np.random.default_rng(seed).standard_normal((rng.randrange(1, 40), 3))
        names = [f"g{k}" for k in range(len(x))]
        got, want = composition.ward_merges(pd.DataFrame(x), names), plain_ward(x, names)
        assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
        assert np.allclose([g[3] for g in got], [w[3] for w in want])


def test_many_groups_are_clustered_cell_by_cell(spark):
    rng = np.random.default_rng(5)
    rows = [(f"#g{k:04d}", float(k % 4) * 20 + float(a), float(k % 4) * 20 + float(b)) for k, (a, b) in enumerate(rng.standard_normal((1000, 2)))]
    frame = spark.createDataFrame(rows, "name string, a double, b double")
    got = sorted(tuple(r) for r in composition.hierarchy(frame, "name", ["a", "b"], most_groups=120).collect())
    assert [r[0] for r in got] == list(range(999)) and got[-1][4] == 1000
    members = {r[0]: frozenset([r[0]]) for r in rows}
    for step, left, right, _, size in got:
        members[f"#{step}"] = members.pop(left) | members.pop(right)
        assert len(members[f"#{step}"]) == size
    assert len(members) == 1
    # the last joins are those of the four groups that lie apart
    sides = [r for r in got if r[4] >= 200]
    assert sum(r[4] == 250 for r in sides) == 4
