import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from cadenza.llm import simhash
from cadenza.llm.graph import components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    parent = {f: f for f in prints.values()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in parent:
        for b in parent:
            if bin(a ^ b).count("1") <= distance:
                parent[find(a)] = find(b)
    least = {}
    for i, f in prints.items():
        least[find(f)] = min(least.get(find(f), i), i)
    return {i: least[find(f)] for i, f in prints.items()}


def test_against_brute_force_with_nulls_ties_and_clashing_columns(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [
        (1, base), (2, base), (3, base + " end"), (4, None), (5, ""), (6, " \t "), (7, "One two"), (8, "one TWO"), (9, "İstanbul çok GÜZEL"),
        (10, base.replace("w7 ", "v7 ")), (11, "x" * 5000)
    ]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, fp int, component string")
    found = {r.id: r for r in simhash.near_duplicates(docs).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    assert {i: r.fp % (1 << 64) for i, r in found.items()} == prints
    assert {i: r.component for i, r in found.items()} == brute_components(prints, 2)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("members", [0, 2, 1000])
def test_full_blocks_lose_and_add_no_link(spark, members):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 6).tolist()
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for centre in centres for k in (0, 1, 1, 2, 2, 3, 4)}
    prints = dict(enumerate(sorted(prints)))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in prints.values()]
    links = simhash.close_pairs(spark.createDataFrame(signed, "fp long"), 2, members)
    roots = {r.node: r.root for r in components(links).collect()}
    mine = {i: roots.get(s[0], s[0]) for i, s in zip(prints, signed)}
    want = brute_components(prints, 2)
    assert all((mine[i] == mine[j]) == (want[i] == want[j]) for i in mine for j in mine)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 180)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 180), 100)}


def test_similar_groups_keep_one_and_leave_the_others(spark):
    rng = np.random.default_rng(3)
    words = [f"t{i}" for i in range(500)]
    text = lambda seed: list(np.random.default_rng(seed).choice(words, 300))
    docs, near = [], text(1)
    docs += [(1, " ".join(near)), (2, " ".join(near)), (3, " ".join(text(2)))]
    for k in range(4, 8):  # four words changed: a similarity of about 0.87
        changed = list(near)
        for p in rng.choice(300, 4, replace=False):
            changed[p] = f"new{k}{p}"
        docs.append((k, " ".join(changed)))
    docs += [(8, None), (None, " ".join(text(9)))]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 8, None]
    assert simhash.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def variants(n, seed=4, changed=6):
    """An original of 300 words and n copies in each of which other words are changed, apart from each other by more than the original."""
    rng = np.random.default_rng(seed)
    original = [f"o{i}" for i in range(300)]
    out = [list(original) for _ in range(n + 1)]
    for k in range(1, n + 1):
        for p in rng.choice(300, changed, replace=False).tolist():
            out[k][p] = f"x{k}y{p}"
    return [" ".join(w) for w in out]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def groups_lose_nothing(spark, texts, most=78):
    """All pairs of Jaccard 0.8 or more within ``most`` bits share a group. The least id is a variant, so no block has the original as its first."""
    docs = spark.createDataFrame([(-i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    group = {r.id: r.component for r in simhash.similar_groups(docs).collect()}
    s = {r.id: np.array(r.s, np.int64).view(np.uint64) for r in simhash.wide_fingerprints(docs).collect()}
    bits = np.bitwise_count(np.array([s[-i] for i in range(len(texts))]) ^ s[0]).sum(axis=1, dtype=int)
    near = [i for i in range(1, len(texts)) if bits[i] <= most and jaccard(texts[0], texts[i]) >= 0.8]
    assert len(near) > len(texts) / 2
    assert [i for i in near if group[-i] != group[0]] == []


def test_an_original_and_thousands_of_variants_are_one_group(spark):
    groups_lose_nothing(spark, variants(2500))


def test_full_blocks_compare_every_pair(spark):
    rng = np.random.default_rng(8)
    s = rng.integers(0, 1 << 62, (6, 8))
    s = np.concatenate(
        [s[k] ^ (np.int64(1) << rng.integers(0, 62, (40, 8))) ^ (np.int64(1) << rng.integers(0, 62, (40, 8))) * (rng.random((40, 8)) < 0.5) for k in range(6)]
    )
    keys = [bytes([i // 256, i % 256]) for i in range(len(s))]
    members = spark.createDataFrame([(0, 5, k, x.tolist(), len(s)) for k, x in zip(keys, s)], "t int, k long, key binary, s array<bigint>, n long")
    bits = np.bitwise_count(s.view(np.uint64)[:, None] ^ s.view(np.uint64)[None]).sum(axis=2, dtype=int)
    for most in (20, 22, 78):
        parent = list(range(len(s)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in np.argwhere(bits <= most).tolist():
            parent[find(i)] = find(j)
        for task_members in (30, 1000):
            links = simhash._full_block_links(members, most, 8, task_members)
            root = {bytes(r.node): bytes(r.root) for r in components(links).collect()}
            mine = [root.get(k, k) for k in keys]
            assert all((mine[i] == mine[j]) == (find(i) == find(j)) for i in range(len(s)) for j in range(i)), (most, task_members)


def test_pairs_meet_whatever_the_other_rows_are(spark):
    """The bands of a text are its own, and nearly all pairs at 0.8 share one."""
    texts = variants(400)
    both = [texts[0], *texts[1:]]
    alone = {r.id: list(r.b) for r in simhash.wide_fingerprints(spark.createDataFrame(list(enumerate(both)), "doc_id long, text string")).collect()}
    close = [i for i in range(1, 401) if jaccard(both[0], both[i]) >= 0.8]
    assert len(close) > 300 and sum(any(x == y for x, y in zip(alone[0], alone[i])) for i in close) == len(close)
    rows = [(bytes([k]), b, [0] * 8) for k, b in enumerate((alone[0], alone[close[0]]))]
    others = [
        (
            b"\xff" + k.to_bytes(4), [int(x) for x in np.random.default_rng(k).integers(-(1 << 62), 1 << 62, simhash.BANDS)], [-1] * 8
        ) for k in range(3000)
    ]
    for more in ([], others):
        links = simhash.candidate_links(spark.createDataFrame(rows + more, "key binary, b array<bigint>, s array<bigint>"), 78)
        assert [(bytes(r.u), bytes(r.v)) for r in links.collect()] == [(b"\x00", b"\x01")]


def linked_texts(n_groups, seed):
    """Groups of copies with 1 to 14 changed words each, so that similarities lie on either side of 0.8, and loners; no two texts are equal."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(n_groups):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(60, 400)))]
        for k in range(int(rng.integers(1, 6))):
            copy = list(base)
            for p in rng.choice(len(base), int(rng.integers(1, max(2, len(base) // 25))), replace=False).tolist():
                copy[p] = f"c{g}k{k}p{p}"
            out.append(" ".join(copy))
    return out


def brute_groups(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle, pairs = {}, set()
    for i, s in enumerate(sets):
        for x in s:
            pairs |= {(j, i) for j in by_shingle.setdefault(x, [])}
            by_shingle[x].append(i)
    close = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in close:
        parent[max(find(i), find(j))] = min(find(i), find(j))
    return close, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("n_groups", [150, 900])
def test_groups_are_those_of_all_pairs_at_the_similarity(spark, n_groups):
    """Jaccard by brute force, no exact copies: at least 0.99 of all linked pairs are found at either size, and nothing else is linked."""
    texts = linked_texts(n_groups, 21)
    close, want = brute_groups(texts)
    found = {r.id: r.component for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(close) > n_groups / 3 and sum(found[i] == found[j] for i, j in close) >= 0.99 * len(close)
    assert all(want[found[i]] == want[i] for i in range(len(texts)))


@pytest.mark.parametrize("options", [{}, {"exact_members": 40, "block_members": 8, "task_members": 50}, {"exact_bytes": 9000}])
def test_a_dense_group_is_whole_and_holds_nothing_else(spark, options):
    """An original, variants at 0.8 and more to it (fewer to each other), and variants that are too far; groups are split over tasks or not."""
    near, far = variants(150, seed=5, changed=6), variants(60, seed=6, changed=12)[1:]
    texts = [*near[1:], *far, near[0]]
    _, want = brute_groups(texts)
    found = {
        r.id: r.component for r in simhash.similar_groups(
            spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options
        ).collect()
    }
    assert [found[i] for i in range(len(texts))] == want and want.count(want[-1]) > 120
