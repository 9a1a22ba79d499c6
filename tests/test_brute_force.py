"""Queries that SQL does not express, against plain loops written from their definitions, on the test tables and on random series."""

import itertools
import math

import numpy as np
import pytest

from cadenza.operators import chaos, composition, features, forms, generators, markov, models, motifs, patterns, reports, shapes, similarity, statistics
from cadenza.plans import catalog
from cadenza.sources import files, midi, views


@pytest.fixture(scope="module")
def pieces(spark, sf_dir):
    """Pitches and durations of each piece, narrow voice and wide voice."""
    out = {}
    for name, view in (("motes", views.motes), ("notes", views.notes)):
        rows = view(spark, sf_dir).orderBy("piece_id", "seq").collect()
        out[name] = {k: [(r.pitch, r.duration, r.start) for r in g] for k, g in itertools.groupby(rows, key=lambda r: r.piece_id)}
    return out


def rows_of(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def plain_palindromes(notes):
    pitch, length = [n[0] for n in notes], [n[1] for n in notes]
    out = []
    for kind, same in (
        ("melodic", lambda a, b: pitch[a] == pitch[b]), ("rhythmic", lambda a, b: abs(length[a] - length[b]) <= 0.1 * max(length[a], length[b]))
    ):
        found = [
            (s, n) for n in range(4, min(len(pitch), 49) + 1) for s in range(len(pitch) - n + 1) if all(
                same(s + k, s + n - 1 - k) for k in range(n // 2)
            )
        ]
        used, kept = set(), []
        for s, n in sorted(found, key=lambda m: -m[1]):
            if not used & set(range(s, s + n)):
                used |= set(range(s, s + n))
                kept.append((kind, s, n))
        out += kept[:20]
    steps = [b - a for a, b in zip(pitch, pitch[1:])]
    answers = [
        ("intervallic", s, n + 1) for n in range(3, min(len(steps), 29) + 1) for s in range(len(steps) - n + 1) if all(
            steps[s + k] == -steps[s + n - 1 - k] for k in range(n // 2)
        )
    ]
    return out + answers[:15]


def plain_mirrors(x, threshold):
    found = [
        (
            round(sum(x[a + k] == x[b + k] for k in range(n)) / n, 3), a, b, n
        ) for n in range(8, min(len(x) // 2, 99) + 1) for a in range(len(x) - 2 * n + 1) for b in range(a + n,
        len(x) - n + 1) if sum(x[a + k] == x[b + k] for k in range(n)) / n >= threshold
    ]
    used, out = set(), []
    for score, a, b, n in sorted(found, key=lambda m: -m[0]):
        if not used & set(range(b, b + n)):
            used |= set(range(b, b + n))
            out.append((a, b, n, score))
    return out[:10]


def test_palindromes_mirrors_and_their_features(spark, sf_dir, pieces):
    want = {p: plain_palindromes(n) for p, n in pieces["motes"].items()}
    assert rows_of(
        catalog.QUERIES["palindromes"](spark, sf_dir), "piece_id", "kind", "start", "length"
    ) == sorted((p, *r) for p, rs in want.items() for r in rs)
    some = dict(list(pieces["motes"].items())[:5])
    mirrors = {p: plain_mirrors([x[0] for x in n], 0.75) for p, n in some.items()}
    got = rows_of(forms.structural_mirrors(views.motes(spark, sf_dir), threshold=0.75), "piece_id", "a_start", "b_start", "length", "similarity")
    assert [r for r in got if r[0] in some] == sorted((p, *r) for p, rs in mirrors.items() for r in rs)
    strict = {p: len(plain_mirrors([x[0] for x in n], 0.8)) for p, n in some.items()}
    for r in catalog.QUERIES["palindrome_features"](spark, sf_dir).collect():
        found, n = want[r.piece_id], len(pieces["motes"][r.piece_id])
        covered = {k: sum(f[2] for f in found if f[0] == k) for k in ("melodic", "rhythmic", "intervallic")}
        assert r.melodic_count == sum(f[0] == "melodic" for f in found) and abs(r.density - sum(covered.values()) / n) < 1e-6
        assert r.longest_rhythmic == max((f[2] for f in found if f[0] == "rhythmic"), default=0)
        if r.piece_id in some:
            score = (
                covered["melodic"] * 0.3 + covered["rhythmic"] * 0.25 + covered["intervallic"] * 0.25
            ) / n + min(strict[r.piece_id] * 0.1, 0.2) * 0.2
            assert r.mirror_count == strict[r.piece_id] and abs(r.symmetry - min(1.0, score)) < 1e-6


def plain_key(energy):
    mean = sum(energy) / 12
    centred = [e - mean for e in energy]
    length = math.sqrt(sum(c * c for c in centred))
    if length < 1e-12:
        return "C major", 0.0
    profiles, best = dict(shapes.keys()), ("", -9.0)
    for name in shapes.NAMES:
        for mode in ("major", "minor"):
            score = sum(a * b for a, b in zip(centred, profiles[f"{name} {mode}"])) / length
            if score > best[1] + 1e-11:
                best = (f"{name} {mode}", score)
    return best[0], max(0.0, best[1])


def frames_of(notes):
    last = max(int(s // 4) for _, _, s in notes)
    out = [[0.0] * 12 for _ in range(last + 1)]
    for pitch, duration, start in notes:
        out[int(start // 4)][pitch % 12] += duration
    return out


def mean_of(frames):
    return [sum(f[k] for f in frames) / len(frames) for k in range(12)]


def test_key_segments_modulations_and_cycles(spark, sf_dir, pieces):
    want, moves = [], []
    for p, notes in pieces["notes"].items():
        chroma, at, own = frames_of(notes), 0, []
        while at < len(chroma):
            end = min(at + 8, len(chroma))
            key, strength = plain_key(mean_of(chroma[at:end]))
            begin = at
            while end < len(chroma):
                further, sure = plain_key(mean_of(chroma[end : end + 2]))
                if further != key or sure <= 0.3:
                    break
                end = min(end + 2, len(chroma))
            if end - begin >= 2:
                own.append((p, len(own), begin, end, key))
            at = end
        want += own
        for a, b in zip(own, own[1:]):
            if a[4] != b[4]:
                roots = [shapes.NAMES.index(x[4].split()[0]) * 7 % 12 for x in (a, b)]
                d = min(abs(roots[0] - roots[1]), 12 - abs(roots[0] - roots[1]))
                moves.append((p, b[2] * 4.0, a[4], b[4], d, "diatonic" if d <= 1 else "chromatic" if d <= 3 else "distant"))
    assert rows_of(catalog.QUERIES["key_segments"](spark, sf_dir), "piece_id", "segment", "start_frame", "end_frame", "key") == sorted(want)
    assert rows_of(catalog.QUERIES["modulations"](spark, sf_dir), "piece_id", "time", "from_key", "to_key", "distance", "kind") == sorted(moves)
    cycles = []
    for p, notes in pieces["notes"].items():
        chroma = frames_of(notes)
        n, own = len(chroma), []
        for size in (1, 2, 3, 5, 8, 13, 21, 34):
            for at in range(n - 2 * size if size < n else 0):
                a, b = sum(chroma[at : at + size], []), sum(chroma[at + size : at + 2 * size], [])
                length = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
                if length > 0 and sum(x * y for x, y in zip(a, b)) / length > 0.8:
                    own.append((p, "fibonacci", size, at))
        peaks = [k for k in range(n) if max(chroma[k]) > 0.5]
        gaps = [(p, "prime", b - a, a) for a, b in zip(peaks, peaks[1:]) if b - a in (2, 3, 5, 7, 11, 13, 17, 19, 23)]
        cycles += own[:10] + gaps[:10]
    got = [r for r in rows_of(catalog.QUERIES["chroma_cycles"](spark, sf_dir), "piece_id", "kind", "number", "frame") if r[1] != "golden"]
    assert got == sorted(cycles)


def test_chroma_geometry_is_that_of_the_covariance(spark, sf_dir, pieces):
    for r in patterns.chroma_geometry(shapes.chroma(views.notes(spark, sf_dir))).collect():
        notes = pieces["notes"][r.piece_id]
        x = np.array([f for k, f in enumerate(frames_of(notes)) if any(int(s // 4) == k for _, _, s in notes)])
        second, first = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[1::-1] ** 2
        assert abs(r.variance - x.var(axis=0).mean()) < 1e-9 and abs(
            r.eccentricity - math.sqrt(1 - (second / first) ** 2)
        ) < 1e-6 and abs(r.circularity + r.eccentricity - 1) < 1e-12


def test_motifs_and_their_null_models(spark, sf_dir, pieces):
    got = {}
    for r in motifs.mine(views.motes(spark, sf_dir), least_length=3, most_length=5, least_support=2, shuffles=4, top=None).collect():
        got.setdefault(r.piece_id, {})[r.pattern] = (r.length, r.support, r.z)
    for p, notes in list(pieces["motes"].items())[:4]:
        steps = [b[0] - a[0] for a, b in zip(notes, notes[1:])]
        rng, want = np.random.default_rng(42), {}
        for n in (3, 4, 5):
            grams = [tuple(steps[i : i + n]) for i in range(len(steps) - n + 1)]
            for g in dict.fromkeys(grams):
                if grams.count(g) >= 2:
                    mixed, counts = np.array(steps), []
                    for _ in range(4):
                        rng.shuffle(mixed)
                        listed = mixed.tolist()
                        counts.append(sum(tuple(listed[i : i + n]) == g for i in range(len(steps) - n + 1)))
                    mean = sum(counts) / 4
                    spread = math.sqrt(sum((c - mean) ** 2 for c in counts) / 4)
                    spread = math.sqrt(mean + 1e-8) if spread < 1e-6 else spread
                    want[",".join(map(str, g))] = (n, grams.count(g), (grams.count(g) - mean) / spread)
        own = got.get(p, {})
        assert own.keys() == want.keys() and all(own[k][:2] == want[k][:2] and abs(own[k][2] - want[k][2]) < 1e-9 for k in want)


def test_recurrence_and_lyapunov_by_plain_loops():
    rng = np.random.default_rng(3)
    for x in (rng.integers(0, 7, 70).astype(float), np.cumsum(rng.normal(size=90))):
        points = [(x[i], x[i + 1], x[i + 2]) for i in range(len(x) - 2)]
        n = len(points)
        d = [[math.dist(a, b) for b in points] for a in points]
        limit = np.percentile([v for row in d for v in row if v > 0], 10)
        hit = [[v <= limit for v in row] for row in d]
        measures = chaos.recurrence_measures(chaos.recurrence(x))
        assert abs(measures["recurrence_rate"] - (sum(map(sum, hit)) - n) / (n * (n - 1))) < 1e-12

        def runs(lines):
            return [len(list(g)) for line in lines for v, g in itertools.groupby(line) if v]

        diagonal = runs([[hit[i][i + k] for i in range(n - k)] for k in range(1, n)])
        vertical = runs([[hit[i][j] for i in range(n)] for j in range(n)])
        assert abs(measures["determinism"] - sum(r for r in diagonal if r >= 2) / max(1, sum(diagonal))) < 1e-12
        assert abs(measures["laminarity"] - sum(r for r in vertical if r >= 2) / max(1, sum(vertical))) < 1e-12
        partner = {}
        for i in range(n - 20):
            far = [(d[i][j], j) for j in range(n) if abs(i - j) > 5]
            if far:
                partner[i] = min(far)[1]
        means = []
        for k in range(20):
            logs = [math.log(d[i + k][j + k]) for i, j in partner.items() if i + k < n and j + k < n and d[i + k][j + k] > 0]
            if logs:
                means.append((k, sum(logs) / len(logs)))
        want = np.polyfit(*zip(*means), 1)[0] if len(means) >= 3 else 0.0
        for block in (1, 7, 1 << 20):
            chaos._BLOCK_PAIRS, before = block * n, chaos._BLOCK_PAIRS
            try:
                assert abs(chaos.lyapunov(x) - want) < 1e-9
            finally:
                chaos._BLOCK_PAIRS = before


def test_mean_similarity_of_windows_is_that_of_all_pairs():
    rng = np.random.default_rng(5)
    for n in (12, 29, 31, 60, 140):
        x = rng.integers(30, 90, n)
        hist = features.window_histograms(x, 20)
        pairs = [float(hist[i] @ hist[j]) for i in range(len(hist)) for j in range(i + 5, len(hist))]
        want = sum(pairs) / len(pairs) if len(hist) >= 10 and pairs else 0.0
        assert abs(features._mean_similarity(x, 20, 5) - want) < 1e-12


def test_common_subsequences_and_comparisons(spark, sf_dir, pieces):
    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = rng.integers(0, 5, int(rng.integers(0, 9))).tolist(), rng.integers(0, 5, int(rng.integers(0, 9))).tolist()
        found = similarity.lcs_backtrack(a, b)
        longest = max(len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if _within(c, b))
        assert len(found) == longest == similarity.lcs(np.array(a), np.array(b)) and _within(found, a) and _within(found, b)
    row = similarity.compare(views.notes(spark, sf_dir), 0, 1).first()
    a, b = (np.array([n[0] for n in pieces["notes"][k]]) for k in (1, 0))
    assert list(row.common) == similarity.lcs_backtrack(a, b, 1.0) and row.lcs_length == len(row.common)
    m = min(len(a), len(b))
    assert abs(row.r - np.corrcoef(a[:m], b[:m])[0, 1]) < 1e-9


def _within(part, whole):
    rest = iter(whole)
    return all(any(x == y for y in rest) for x in part)


def test_components_are_those_of_a_singular_value_decomposition(spark, sf_dir):
    from cadenza.plans.models import _COLUMNS
    from cadenza.plans.features import matrix

    rows = matrix(spark, sf_dir).orderBy("piece_id").toPandas()
    x = rows[_COLUMNS].to_numpy(float)
    spread = x.std(axis=0)
    x = (x - x.mean(axis=0)) / np.where(spread > 0, spread, 1)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    got = catalog.QUERIES["principal_components"](spark, sf_dir).orderBy("piece_id").toPandas()[["pc1", "pc2"]].to_numpy()
    for k in range(2):
        want = u[:, k] * s[k]
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-4


def test_hierarchy_joins_what_raises_the_squares_least():
    import pandas as pd

    rng = np.random.default_rng(9)
    x = rng.normal(size=(9, 4))
    merges = composition.ward_merges(pd.DataFrame(x), [f"g{i}" for i in range(9)])
    groups = {f"g{i}": [i] for i in range(9)}
    squares = lambda rows: float(((x[rows] - x[rows].mean(axis=0)) ** 2).sum())
    for step, left, right, distance, size in merges:
        rise = {(a, b): squares(groups[a] + groups[b]) - squares(groups[a]) - squares(groups[b]) for a, b in itertools.combinations(groups, 2)}
        least = min(rise.values())
        mine = rise.get((left, right), rise.get((right, left)))
        assert abs(mine - least) < 1e-9 and abs(distance - math.sqrt(2 * least)) < 1e-9
        groups[f"#{step}"] = groups.pop(left) + groups.pop(right)
        assert size == len(groups[f"#{step}"])
    assert len(merges) == 8


def test_compositions_keep_their_rules(spark, sf_dir):
    p = models.markov_matrix(views.notes(spark, sf_dir))
    for style in ("baroque", "romantic", "classical", "late_romantic", "other"):
        made = composition.compose(spark, p, style, samples=3, bars=8, tonic=62, key="G_major").collect()
        again = composition.compose(spark, p, style, samples=3, bars=8, tonic=62, key="G_major").collect()
        assert made == again
        for sample in range(3):
            own = sorted((r for r in made if r.sample == sample), key=lambda r: r.seq)
            assert abs(sum(r.duration for r in own) - 32.0) < 1e-9 and own[0].start == 0.0
            assert all(abs(a.start + a.duration - b.start) < 1e-9 for a, b in zip(own, own[1:]))
            lengths = composition.LENGTHS.get(style, composition.LENGTHS["classical"])[0]
            assert all(r.duration in lengths for r in own[:-1]) and all(36 <= r.pitch <= 83 for r in own)
            low, high = composition.TEMPI.get(style, (90, 91))
            assert low <= own[0].tempo < high
            if len(own) >= 10:
                assert not own[0].meets_style or composition.meets(style, composition.summary([r.pitch for r in own]))
            before = 62
            for r in own:
                assert r.pitch // 12 == min(range(3, 7), key=lambda o: abs(r.pitch % 12 + 12 * o - before))
                before = r.pitch
    boosted = composition.chances(p, 0, key="C_major")
    plain = composition.chances(p, 0)
    scale = list(reports.SCALES["C_major"])
    assert abs(boosted.sum() - 1) < 1e-12 and boosted[scale].sum() > plain[scale].sum()
    assert np.allclose(composition.chances(np.zeros((12, 12)), 5), 1 / 12)
    for emotion in (*composition.EMOTIONS, "balanced"):
        sung = composition.emotional(spark, p, emotion, samples=2, length=6).collect()
        assert len(sung) == 12 and all(36 <= r.pitch <= 96 for r in sung)


def test_beauty_weights_follow_significant_correlations(spark):
    rng = np.random.default_rng(8)
    rows = [tuple(float(v) for v in (a, b, rng.normal(), rng.normal() * 0 + 1, 2 * a - b + 0.1 * rng.normal())) for a, b in rng.normal(size=(60, 2))]
    df = spark.createDataFrame(rows, "pitch_entropy double, consonance_score double, repetition_index double, fractal_dimension double, liked double")
    got = {r.feature: r for r in statistics.beauty_weights(df, "liked").collect()}
    x = np.array(rows)
    r = {c: np.corrcoef(x[:, k], x[:, 4])[0, 1] for k, c in enumerate(("pitch_entropy", "consonance_score", "repetition_index"))}
    assert all(abs(got[c].r - r[c]) < 1e-9 for c in r) and got["pitch_entropy"].p < 0.05 and got["consonance_score"].p < 0.05
    strong = {c: abs(r[c]) for c in r if got[c].p < 0.05}
    raw = {c: strong[c] / sum(strong.values()) if c in strong else statistics.BEAUTY[c] for c in statistics.BEAUTY}
    assert all(abs(got[c].weight - raw[c] / sum(raw.values())) < 1e-9 for c in raw)


def test_markov_features_are_made_of_their_parts(spark, sf_dir, pieces):
    from pyspark.sql import functions as F

    notes = views.motes(spark, sf_dir)
    rate = {r.piece_id: r for r in markov.entropy_rate(markov.smoothed(notes, F.col("pitch"))).collect()}
    for r in markov.features(notes).collect():
        own = [n[0] for n in pieces["motes"][r.piece_id]]
        moves = list(zip(own, own[1:]))
        assert r.pitch_states == len(set(own)) and abs(r.pitch_entropy - rate[r.piece_id].entropy) < 1e-9
        common = [m for m in set(moves) if moves.count(m) >= 2]
        assert r.common_transitions == min(20, len(common)) and abs(r.top_share - max(moves.count(m) for m in common) / len(moves)) < 1e-9


#: First terms worked out by hand from the definitions; 12 begins with a prime, 17 sieves by its second number first, 19 steps by 0 first, 52 rounds down.
KNOWN = {
    1: [1, 1, 2, 3, 5, 8, 13, 21], 2: [2, 1, 3, 4, 7, 11, 18, 29], 5: [0, 1, 2, 5, 12, 29, 70, 169], 6: [0, 1, 1, 3, 5, 11, 21, 43],
    10: [1, 1, 2, 5, 14, 42, 132, 429],
    11: [2, 3, 5, 7, 11, 13, 17, 19], 12: [2, 1, 2, 2, 4, 2, 4, 2], 16: [1, 1, 2, 2, 4, 2, 6, 4], 17: [1, 3, 5, 7, 11, 13, 17, 21],
    18: [1, 2, 2, 3, 3, 4, 4, 4], 19: [0, 0, 1, 3, 6, 2, 7, 13],
    38: [0, 1, 1, 0, 1, 0, 0, 1], 52: [1, 1, 1, 2, 4, 9, 20, 48], 55: [1, 1, 2, 5, 15, 52, 203, 877], 56: [0, 1, 3, 2, 6, 7, 5, 4],
    57: [1, 1, 1, -1, 1, 1, -1, 1], 73: [1, -1, -1, 1, -1, 1, -1, -1],
    74: [1, -1, -1, 0, -1, 1, -1, 0], 75: [1, 3, 4, 7, 6, 12, 8, 15], 92: [1, 1, 2, 3, 3, 4, 5, 5], 99: [0, 0, 0, 0, 1, 0, 0, 0],
}


@pytest.mark.parametrize("number", sorted(KNOWN))
def test_first_terms_of_known_sequences(number):
    assert [int(v) for v in generators.values(number, 8)] == KNOWN[number]


def test_files_in_and_out(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nin two lines', 0.5), (2, None, None), (3, "", 1.0)]
    df = spark.createDataFrame(rows, "id int, text string, x double")
    files.write_csv(df, f"{tmp_path}/c")
    files.write_json(df, f"{tmp_path}/j")
    assert sorted(map(tuple, files.read_csv(spark, f"{tmp_path}/c", df.schema).collect())) == rows
    assert sorted(map(tuple, files.read_json(spark, f"{tmp_path}/j", df.schema).collect())) == rows
    assert files.read_csv(spark, f"{tmp_path}/none", df.schema).count() == 0 and files.numeric_features(df) == ["id", "x"]
    (tmp_path / "m" / "sub").mkdir(parents=True)
    for name in ("a.mid", "sub/b.mid", "c.txt"):
        (tmp_path / "m" / name).write_bytes(b"x")
    template = files.metadata_template(spark, f"{tmp_path}/m").collect()
    assert sorted(
        r.file_path.rpartition("/")[2] for r in template
    ) == ["a.mid",
    "b.mid"] and {r.quality_flag for r in template} == {1} and template[0].asDict().keys() == {c.split()[0] for c in files.METADATA.split(", ")}
    (tmp_path / "config.json").write_text('{"seed": 7}')
    assert files.load_config(spark, f"{tmp_path}/config.json") == files.Config(seed=7) and files.load_config(spark) == files.Config()
    assert [r.value for r in similarity.resolve_series(spark, "pattern", 1, most=6).orderBy("index").collect()] == [1.0, 1.0, 2.0, 3.0, 5.0, 8.0]
    assert similarity.resolve_series(spark, "custom", [2, 3.5]).count() == 2
    with pytest.raises(ValueError):
        similarity.resolve_series(spark, "other", [])


def test_midi_bytes(spark, tmp_path):
    """A file written by hand with running status, a silent note-on as the end, a held note, two tracks and a system message."""
    one = bytes([0, 0xFF, 0x51, 3, 0x07, 0xA1, 0x20, 0, 0xC1, 5, 0, 0x91, 60, 90, 48, 64, 80, 48, 60, 0, 0, 64, 0, 0, 0xFF, 0x2F, 0])
    two = bytes([0, 0xF0, 2, 1, 0xF7, 0x81, 0x40, 0x90, 67, 70, 96, 0xFF, 0x2F, 0])
    data = b"MThd" + bytes([0, 0, 0, 6, 0, 1, 0, 2, 0, 96]) + b"".join(b"MTrk" + len(t).to_bytes(4, "big") + t for t in (one, two))
    assert midi.parse(data) == [(0, 1, 5, 60, 90, 0.0, 1.0), (0, 1, 5, 64, 80, 0.5, 0.5), (1, 0, 0, 67, 70, 2.0, 1.0)]
    assert midi.tempi(data) == [(0.0, 120.0)] and midi.tempi(midi.with_tempo(data, 60)) == [(0.0, 60.0)] and midi.parse(midi.with_tempo(data, 60)) == midi.parse(data)
    own = [(60, 0.0, 1.0, 64, 3), (64, 0.5, 0.25, 99, 40), (60, 1.0, 2.0, 1, 3)]
    assert [(p, s, d, v, g) for _, _, g, p, v, s, d in midi.parse(midi.write(own))] == own
    for name, content in (("a.mid", data), ("b.mid", b"no midi"), ("c.mid", data[:40])):
        (tmp_path / name).write_bytes(content)
    rows = midi.read(spark, str(tmp_path)).collect()
    assert sorted(r.file.rpartition("/")[2] for r in rows) == ["a.mid"] * 3 + ["b.mid", "c.mid"]
    assert all((r.error is None) == r.file.endswith("a.mid") for r in rows)


def test_sampled_shapley_values(spark, sf_dir, pieces):
    from cadenza.operators import games

    got = {r.piece_id: r for r in games.shapley(views.notes(spark, sf_dir), samples=20).collect()}
    pay = lambda row: [games.PAYOFF[abs(a - b)] for a, b in zip(row, row[1:])]
    for p, notes in list(pieces["notes"].items())[:5]:
        pcs = [n[0] % 12 for n in notes]
        present, rng, given = np.unique(pcs), np.random.default_rng(42), dict.fromkeys(range(12), 0.0)
        for _ in range(20):
            inside, before = set(), 0.0
            for pc in rng.permutation(present).tolist():
                inside.add(pc)
                kept = [x for x in pcs if x in inside]
                if len(kept) > 1:
                    value = sum(pay(kept)) / (len(kept) - 1)
                    given[pc] += value - before
                    before = value
        mean = {pc: v / 20 for pc, v in given.items()}
        sizes = sorted(abs(v) for v in mean.values() if v)
        n = len(sizes)
        gini = abs(sum((2 * k - n - 1) * x for k, x in enumerate(sizes, 1)) / (n * sum(sizes)))
        best = max(range(12), key=lambda pc: (mean[pc] if pc in present else 0, -pc))
        assert got[p].shapley_top_pc == best and abs(got[p].shapley_gini - gini) < 1e-9


def test_random_walk_scores_and_the_aesthetic_index(spark, sf_dir, pieces):
    want = {}
    for p, notes in pieces["notes"].items():
        steps = np.array([b[0] - a[0] for a, b in zip(notes, notes[1:])], float)
        unit, rng = (steps - steps.mean()) / steps.std(), np.random.default_rng(42)
        lags = min(8, len(steps) // 2)

        def measure(z):
            return sum(abs(sum(z[i] * z[i + k] for i in range(len(z) - k)) / (len(z) - k)) for k in range(1, lags + 1)) / lags

        null = []
        for _ in range(20):
            mixed = unit.copy()
            rng.shuffle(mixed)
            null.append(measure(mixed))
        own = measure(unit)
        want[p] = (own, (own - np.mean(null)) / np.std(null))
    got = {r.piece_id: r for r in catalog.QUERIES["nonrandomness"](spark, sf_dir).collect()}
    assert all(abs(got[p].rw_corr_mean - a) < 1e-6 and abs(got[p].rw_corr_z - z) < 1e-5 for p, (a, z) in want.items())
    rows = {r.piece_id: r for r in catalog.QUERIES["numeric_patterns"](spark, sf_dir).collect()}
    ids = sorted(rows)
    z = lambda x: (x - x.mean()) / x.std() if x.std() > 1e-12 else x * 0
    prime, phi = (np.array([getattr(rows[p], c) for p in ids]) for c in ("prime_sum_ratio", "phi_density_ratio"))
    raw = 0.25 * z(prime) + 0.25 * z(phi) + 0.5 * z(np.array([want[p][1] for p in ids]))
    index = {r.piece_id: r for r in catalog.QUERIES["aesthetic_index"](spark, sf_dir).collect()}
    scaled = (raw - raw.min()) / (raw.max() - raw.min())
    assert all(abs(index[p].aesthetic_z_raw - a) < 1e-4 and abs(index[p].aesthetic_index - b) < 1e-4 for p, a, b in zip(ids, raw, scaled))


def test_shapes_on_the_pitch_circle(spark, sf_dir, pieces):
    def spread(points):
        middle = sum(points) / len(points)
        arms = [q - middle for q in points]
        radii = [abs(a) for a in arms]
        mean = sum(radii) / len(radii)
        turns = []
        for a, b in zip(arms, arms[1:] + arms[:1]):
            d = abs(np.angle(b) - np.angle(a))
            turns.append(min(d, 2 * math.pi - d))
        return (math.sqrt(sum((r - mean) ** 2 for r in radii) / len(radii)) / mean if mean > 1e-9 else math.inf), turns

    want = []
    for p, notes in pieces["motes"].items():
        at = [complex(math.cos(t), math.sin(t)) for t in ((n[0] % 12) / 12 * 2 * math.pi - math.pi / 2 for n in notes)]
        found = []
        for corners, name in patterns.SHAPES.items():
            for s in range(len(at) - corners + 1):
                v, turns = spread(at[s : s + corners])
                ideal = [t / (2 * math.pi / corners) - 1 for t in turns]
                uneven = sum((x - sum(ideal) / corners) ** 2 for x in ideal) / corners
                if v < 0.1 and uneven < 0.1:
                    found.append((p, name, s, corners, round(1 - (v + uneven) / 2, 3)))
        used, kept = set(), []
        for shape in sorted(found, key=lambda f: -f[4]):
            if not used & set(range(shape[2], shape[2] + shape[3])):
                used |= set(range(shape[2], shape[2] + shape[3]))
                kept.append(shape[:4])
        stars = []
        for corners, name in ((5, "star_pentagon"), (6, "star_triangle")):
            for s in range(len(at) - corners + 1):
                if spread([at[s + k * 2 % corners] for k in range(corners)])[0] < 0.15:
                    stars.append((p, name, s, corners))
        want += kept[:10] + stars[:5]
    assert rows_of(catalog.QUERIES["circle_shapes"](spark, sf_dir), "piece_id", "shape", "start", "corners") == sorted(want)
    assert {r.piece_id: r.shapes for r in patterns.geometric_complexity(views.motes(spark, sf_dir)).collect()} == {p: sum(w[0] == p for w in want) for p in pieces["motes"]}
