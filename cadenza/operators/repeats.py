"""Maximal repeats of a piece, by a suffix automaton, and motifs against one set of shuffles for all patterns of a length."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def automaton(values: list[int]) -> tuple[list[int], list[int], list[dict[int, int]], list[int], list[int]]:
    """(length, link, transitions, occurrences, first end) of each state of the suffix automaton of a sequence (Blumer et al., 1985): at most
    twice as many states as values, built in time proportional to them.
    """
    length, link, arcs, count, first = [0], [-1], [{}], [0], [-1]
    last = 0
    for k, value in enumerate(values):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        arcs.append({})
        count.append(1)
        first.append(k)
        p = last
        while p >= 0 and value not in arcs[p]:
            arcs[p][value] = new
            p = link[p]
        if p >= 0:
            q = arcs[p][value]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                arcs.append(dict(arcs[q]))
                count.append(0)
                first.append(first[q])
                while p >= 0 and arcs[p].get(value) == q:
                    arcs[p][value] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        count[link[state]] += count[state]
    return length, link, arcs, count, first


def repeats_of(values: list[int], least_length: int, least_support: int) -> list[tuple[int, int, int]]:
    """(first start, length, support) of the runs that occur at least so often and would occur less often with any value more on either side."""
    length, _, arcs, count, first = automaton(values)
    out = []
    for state in range(1, len(length)):
        # the longest run of a state cannot grow to the left; it can to the right if all of its occurrences go on alike
        if length[state] >= least_length and count[state] >= least_support and all(count[t] < count[state] for t in arcs[state].values()):
            out.append((first[state] - length[state] + 1, length[state], count[state]))
    return sorted(out)


def maximal_repeats(notes: DataFrame, least_length: int = 3, least_support: int = 2) -> DataFrame:
    """(piece_id, first_position, length, support): maximal repeats of a piece's intervals, of any length; occurrences may overlap. The pattern is the
    run of intervals from first_position on, so the result is no longer than twice the piece.
    """

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        steps = np.diff(piece.sort_values("seq")["pitch"].to_numpy()).tolist()
        found = repeats_of(steps, least_length, least_support)
        out = pd.DataFrame([(piece["piece_id"].iloc[0], *r) for r in found], columns=["piece_id", "first_position", "length", "support"])
        return out.astype({"piece_id": "int64", "first_position": "int32", "length": "int32", "support": "int64"})

    return notes.select("piece_id", "seq", "pitch").groupBy("piece_id").applyInPandas(
        run, "piece_id bigint, first_position int, length int, support bigint"
    )


def _counted(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position, support, the windows as rows) of each different run of n values, in order of their values."""
    windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(values, n))
    rows, first, support = np.unique(windows, axis=0, return_index=True, return_counts=True)
    return first, support, rows


def _found(rows: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """How often each wanted run stands among different runs in order."""
    both = np.concatenate([rows, wanted])
    _, number = np.unique(both, axis=0, return_inverse=True)
    number, out = number.ravel(), np.zeros(len(both), np.int64)
    out[number[: len(rows)]] = counts
    return out[number[len(rows) :]]


def significance(notes: DataFrame, least_length: int = 4, most_length: int = 12, least_support: int = 3, shuffles: int = 25, seed: int = 42) -> DataFrame:
    """(piece_id, length, first_position, support, z): runs of intervals that occur at least so often, against shuffles of the piece's intervals.

    Each shuffle is counted once for all runs of a length, so that the work is that of sorting the piece ``shuffles`` times for each length, however
    many runs there are. The shuffles of a length come from the seed and the length.
    """

    def run(piece: pd.DataFrame) -> pd.DataFrame:
        steps, rows = np.diff(piece.sort_values("seq")["pitch"].to_numpy()), []
        for n in range(least_length, min(most_length, len(steps)) + 1):
            first, support, runs = _counted(steps, n)
            often = support >= least_support
            if not often.any():
                continue
            rng, counts = np.random.default_rng([seed, n]), []
            for _ in range(shuffles):
                _, c, r = _counted(rng.permutation(steps), n)
                counts.append(_found(r, c, runs[often]))
            mean, deviation = np.mean(counts, axis=0), np.std(counts, axis=0)
            deviation = np.where(deviation < 1e-6, np.sqrt(mean + 1e-8), deviation)
            rows += zip([n] * int(often.sum()), first[often].tolist(), support[often].tolist(), ((support[often] - mean) / deviation).tolist())
        out = pd.DataFrame([(piece["piece_id"].iloc[0], *r) for r in rows], columns=["piece_id", "length", "first_position", "support", "z"])
        return out.astype({"piece_id": "int64", "length": "int32", "first_position": "int32", "support": "int64", "z": "float64"})

    return notes.select("piece_id", "seq", "pitch").groupBy("piece_id").applyInPandas(
        run, "piece_id bigint, length int, first_position int, support bigint, z double"
    )
