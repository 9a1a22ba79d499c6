"""One hundred number sequences, by id, in long and wide form.

Four kinds: closed forms of the index, recurrences of a state, cycled tables, and the few that need their own walk. Values are exact where they
can be: integers and fractions of any size are written as text beside their double.

Deviations that belong to the definitions: 17 sieves by the element after the first pass, so it is not the usual lucky sequence; 19 starts its
steps at zero; 37 is constant; 52 and 58 differ from the standard sequences; 59 appends alternating values; 8 is Stern's sequence, 72 the list
of known perfect numbers; 71 and 72 end early; 78 is the single fraction one.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import accumulate, cycle, islice, repeat
from math import comb, cos, floor, gcd, pi, sin, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PHI = (1 + sqrt(5)) / 2
#: The integer whose quotients' parities sequence 99 reads.
BITMAP = 960939379918958884971672962127852754715004339660129306651505519271702802395266424689642842174350718121267153782770623355993237280874144307891325963941337723487857735749823926629715517173716995165232890538221612403238855866184013235585136048828693337902491454229288667081096184496091705183454067827731551705405381627380967602565625016981482083418783163849115590225610003652351370343874461848378737238198224849863465033159410054974700593138339226497249461751545728366702369745461014655997933798537483143786841806593422227898388722980000748404719


def _factors(n: int) -> list[int]:
    out, d = [], 2
    while n > 1:
        if d * d > n:
            return [*out, n]
        while n % d == 0:
            out.append(d)
            n //= d
        d += 1
    return out


def _prime(n: int) -> bool:
    return n > 1 and len(_factors(n)) == 1


def _primes(n: int) -> list[int]:
    return list(islice((k for k in iter(lambda c=[1]: c.__setitem__(0, c[0] + 1) or c[0], None) if _prime(k)), n))


def _adjacent_ones(i: int) -> int:
    return (i & (i >> 1)).bit_count()


def _even_zero_runs(i: int) -> int:
    """1 if all runs of zeros inside the binary digits, trailing ones aside, have even length."""
    return int(all(len(run) % 2 == 0 for run in bin(i)[2:].rstrip("0").split("1"))) if i else 1


def _in_cantor(t: float, depth: int) -> int:
    low, high = 0.0, 1.0
    segments = [(low, high)]
    for _ in range(depth):
        segments = [s for a, b in segments for s in ((a, a + (b - a) / 3), (b - (b - a) / 3, b))]
    return int(any(a <= t <= b for a, b in segments))


def _stirling(n: int, k: int) -> int:
    row = [1]
    for m in range(n):
        row = [(m * row[j] if j < len(row) else 0) + (row[j - 1] if j else 0) for j in range(m + 2)]
    return row[k] if k < len(row) else 0


def _hilbert_x(side: int, at: int) -> int:
    x = y = 0
    for s in (1 << k for k in range(max(0, side.bit_length() - 1))):
        rx, ry = at >> 1 & 1, (at & 1) ^ (at >> 1 & 1)
        if not ry:
            x, y = (s - 1 - y, s - 1 - x) if rx else (y, x)
        x, y, at = x + s * rx, y + s * ry, at >> 2
    return x


def _convergents(term: Callable[[int], int]) -> Iterator[float]:
    h, k, ph, pk = 1, 0, 0, 1
    for i in iter(lambda c=[-1]: c.__setitem__(0, c[0] + 1) or c[0], None):
        h, ph, k, pk = term(i) * h + ph, h, term(i) * k + pk, k
        yield h / k


#: Value at index i of n.
CLOSED: dict[int, Callable[[int, int], object]] = {
    16: lambda i, n: sum(gcd(k, i + 1) == 1 for k in range(1, i + 2)), 21: lambda i, n: Fraction(1, i + 1), 22: lambda i, n: 220.0 * (i + 1),
    25: lambda i, n: sin(2 * pi * 5 * i / 100),
    26: lambda i, n: sin(3 * (2 * pi * i / n)), 27: lambda i, n: sin(2 * (2 * pi * i / n) + pi / 4),
    28: lambda i, n: cos(5 * math.acos(max(-1, min(1, cos(pi * i / n))))),
    29: lambda i, n: sum(sin(k * (2 * pi * i / n)) / k for k in (1, 3, 5, 7, 9)),
    30: lambda i, n: cos(2 * pi * 5 * (i / 100)) + cos(2 * pi * 5.5 * (i / 100)),
    36: lambda i, n: 1 << i.bit_count(), 37: lambda i, n: 1, 38: lambda i, n: i.bit_count() % 2, 39: lambda i, n: _in_cantor(i / n, 6),
    43: lambda i, n: 2 ** ((i % 12) / 12), 46: lambda i, n: 2 ** ((i % 41) / 41),
    51: lambda i, n: comb(10, i), 53: lambda i, n: comb(i + 1, min(2, i + 1)) * comb(i + 1, min(2, i + 1) - 1) // (i + 1),
    54: lambda i, n: _stirling(i + 1, max(1, (i + 1) // 2)), 56: lambda i, n: i ^ (i >> 1),
    57: lambda i, n: 1 - 2 * (_adjacent_ones(i) % 2), 58: lambda i, n: _even_zero_runs(i), 61: lambda i, n: i + 0.5,
    62: lambda i, n: math.exp(-(((i - n / 2) / 100) ** 2) / 0.5) * cos(5 * ((i - n / 2) / 100)),
    63: lambda i, n: abs(sin(3 * (2 * pi * i / n))), 64: lambda i, n: sin(2 * pi * 5 * (i / n) + 2 * sin(2 * pi * 3 * (i / n))),
    65: lambda i, n: (1 + cos(2 * pi * (i / n))) * cos(2 * pi * 10 * (i / n)),
    70: lambda i, n: 1 - 2 * (i // max(1, (2 ** (n.bit_length() - i.bit_length()) if i else n) // 2) % 2),
    73: lambda i, n: (-1) ** len(_factors(i + 1)),
    74: lambda i, n: 0 if len(set(_factors(i + 1))) < len(_factors(i + 1)) else (-1) ** len(_factors(i + 1)),
    75: lambda i, n: sum(d for d in range(1, i + 2) if (i + 1) % d == 0), 77: lambda i, n: i % 60, 79: lambda i, n: i,
    86: lambda i, n: _hilbert_x(2 ** math.ceil(math.log2(n)), i), 87: lambda i, n: 5 ** (i % 4),
    90: lambda i, n: floor((i + 1) * PHI) - floor(i * PHI) - 1, 91: lambda i, n: ((i + 1) * sqrt(i + 1)) % (2 * pi) if _prime(i + 1) else 0.0,
    95: lambda i, n: sum(2 ** gcd(k, i + 1) for k in range(i + 1)) // (i + 1), 99: lambda i, n: (BITMAP + 17 - i // 106) // (17 * (i % 106) + 1) % 2,
    100: lambda i, n: i,
}
#: First state, next state, and what a state shows.
RECURRENCE: dict[int, tuple[object, Callable, Callable]] = {
    **{k: (start, step, lambda s: s[0]) for k, start, step in (
        (1, (1, 1), lambda s: (s[1], sum(s))), (2, (2, 1), lambda s: (s[1], sum(s))), (3, (0, 0, 1), lambda s: (*s[1:], sum(s))),
        (4, (1, 1, 1), lambda s: (*s[1:], s[0] + s[1])), (5, (0, 1), lambda s: (s[1], 2 * s[1] + s[0])),
        (6, (0, 1), lambda s: (s[1], s[1] + 2 * s[0])), (7, (3, 0, 2), lambda s: (*s[1:], s[0] + s[1])), (13, (1, 1), lambda s: (s[1], sum(s) % 12)),
        (34, (0.0, 0.0), lambda s: (1 - 1.4 * s[0] ** 2 + s[1], 0.3 * s[0])),
        (35, (1, 0), lambda s: ((s[0] + s[1]) % 12, (s[0] + 2 * s[1]) % 12)),
    )},
    8: (Fraction(1), lambda q: 1 / (2 * floor(q) + 1 - q), lambda q: q.numerator), 9: (2, lambda x: x * (x - 1) + 1, lambda x: x),
    10: ((1, 0), lambda s: (s[0] * 2 * (2 * s[1] + 1) // (s[1] + 2), s[1] + 1), lambda s: s[0]),
    14: (1, lambda x: x * 3 % 7, lambda x: x), 15: (27, lambda x: 3 * x + 1 if x % 2 else x // 2, lambda x: x),
    20: (1234, lambda x: (lambda d: int(d[::-1]) - int(d))("".join(sorted(f"{x:04d}"))) or 1000, lambda x: x),
    24: (Fraction(1), lambda q: (lambda v: v / 2 if v >= 2 else v)(q * Fraction(3, 2)), lambda q: q),
    31: (0.5, lambda x: 3.7 * x * (1 - x), lambda x: x), 32: (0.3, lambda x: 1.9 * min(x, 1 - x), lambda x: x),
    33: (
        (1.0, 1.0, 1.0),
        lambda s: (s[0] + 10 * (s[1] - s[0]) * 0.01, s[1] + (s[0] * (28 - s[2]) - s[1]) * 0.01, s[2] + (s[0] * s[1] - 8 / 3 * s[2]) * 0.01),
        lambda s: s[0]
    ),
    40: (0j, lambda z: (0 if abs(z) > 2 else z) ** 2 + complex(-0.7, 0.27), abs),
    42: (220.0, lambda x: next(v for v in (x * PHI, x * PHI / 2) if v <= 440), lambda x: x),
    66: (
        (0.1, 0.0, 0),
        lambda s: (lambda v: (s[0] + v * 0.05, v, s[2] + 1))(s[1] + (s[0] + s[0] ** 3 - 0.3 * s[1] + 0.5 * cos(1.2 * s[2] * 0.05)) * 0.05),
        lambda s: s[0]
    ),
    67: ((0.5, 0.5), lambda s: (s[0] + s[1] * 0.05, s[1] + (2.0 * (1 - s[0] ** 2) * s[1] - s[0]) * 0.05), lambda s: s[0]),
    68: (
        tuple(pi * k / 5 for k in range(5)),
        lambda p: tuple(a + (w + 2.0 / 5 * sum(sin(b - a) for b in p)) * 0.1 for a, w in zip(p, (1.0, 1.2, 0.8, 1.5, 0.9))), lambda p: sum(p) / 5
    ),
    96: (
        (1, 2 * 2 / (1 * 3)), lambda s: (s[0] + 1, s[1] * ((2 * (s[0] + 1)) * (2 * (s[0] + 1)) / ((2 * (s[0] + 1) - 1) * (2 * (s[0] + 1) + 1)))),
        lambda s: s[1]
    ),
}
#: Tables that repeat, and by how much each round lifts them.
CYCLES: dict[int, tuple[tuple, int]] = {
    23: (tuple(map(Fraction, ("1", "9/8", "5/4", "4/3", "3/2", "5/3", "15/8", "2"))), 0), 41: ((0, 7, 2, 9, 4, 11, 6, 1, 8, 3, 10, 5), 0),
    44: ((0, 2, 3, 5, 7, 9, 10), 12), 45: ((0, 2, 4, 7, 9), 12),
    47: ((0, 1, 0, 1, 1, 0, 1, 1), 0), 48: ((3, 3, 2), 0), 50: ((0, 11, 3, 4, 8, 7, 9, 5, 6, 1, 10, 2), 0),
}


def _sieve(n: int) -> list[int]:
    kept, at = list(range(1, 4 * n)), 1
    while at < min(len(kept), n):
        del kept[kept[at] - 1 :: kept[at]]
        at += 1
    return kept[:n]


def _self_reference(n: int, first: list[int], term: Callable[[list[int], int], int], start: int) -> list[int]:
    out = list(first)
    for i in range(start, n + 1):
        out.append(term(out, i))
    return out[1 : n + 1]


def _recaman(n: int) -> Iterator[int]:
    seen, at = set(), 0
    for i in range(n):
        yield at
        seen.add(at)
        at = at - i if at - i > 0 and at - i not in seen else at + i


def _motzkin(n: int) -> list[int]:
    out = [1, 1]
    for i in range(2, n):
        out.append(((2 * i + 2) * out[-1] + 3 * (i - 1) * out[-2]) // (i + 3))
    return out[:n]


def _bell(n: int) -> list[int]:
    row, out = [1], []
    for _ in range(n):
        out.append(row[0])
        row = list(accumulate(row, initial=row[-1]))
    return out


def _alternating(n: int) -> list[int]:
    out, at = [1, 2], 1
    while len(out) < n:
        out += [out[-1] ^ 3] * (out[at] - 1)
        out.append(out[-1] ^ 3)
        at += 1
    return out[:n]


def _automaton(n: int, rule: int, width: int = 20) -> Iterator[int]:
    cells = [int(k == width // 2) for k in range(width)]
    for _ in range(n):
        yield sum(cells)
        cells = [rule >> (4 * cells[k - 1] + 2 * cells[k] + cells[(k + 1) % width]) & 1 for k in range(width)]


def _life(n: int, side: int = 8) -> Iterator[int]:
    alive = {(i, j) for i in range(side) for j in range(side) if (i + j) % 3 == 0}
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    for _ in range(n):
        yield len(alive)
        count = {(i, j): sum(((i + a) % side, (j + b) % side) in alive for a, b in near) for i in range(side) for j in range(side)}
        alive = {c for c, k in count.items() if k == 3 or (k == 2 and c in alive)}


def _sandpile(n: int, side: int = 5, chips: int = 100) -> Iterator[int]:
    heap = dict.fromkeys(((i, j) for i in range(side) for j in range(side)), 0)
    heap[side // 2, side // 2] = chips
    for _ in range(n):
        yield sum(heap.values())
        before = dict(heap)
        for i, j in heap:
            if heap[i, j] >= 4:
                heap[i, j] -= 4
                for to in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                    if to in heap:
                        heap[to] += 1
        if heap == before:
            heap[side // 2, side // 2] += 10


def _xorshift(n: int, x: int = 12345) -> Iterator[int]:
    for _ in range(n):
        x ^= x << 13
        x ^= x >> 7
        x = (x ^ (x << 17)) % (1 << 32)
        yield x % 1024


def _rewriting(n: int) -> Iterator[int]:
    text = "F"
    for i in range(n):
        yield len(text)
        if i < n - 1:
            text = text.replace("F", "FF+[+F-F-F]-[-F+F+F]")
            text = text[:1000] if len(text) > 10**6 else text


def _delay(n: int) -> list[float]:
    out = [0.5] * 6
    for i in range(n):
        out.append(0.25 * out[-3] - 0.1 * out[-6] + 0.01 * sin(i * 0.3))
    return out[6:]


def _ant(n: int) -> Iterator[int]:
    black, at, facing = set(), 0j, 1j
    for _ in range(n):
        yield int(abs(at.real) + abs(at.imag))
        facing *= 1j if at in black else -1j
        black ^= {at}
        at += facing


def _distances(n: int) -> list[float]:
    rng = random.Random(42)
    centres = sorted(rng.random() for _ in range(5))
    return [min(abs(i / n - c) for c in centres) for i in range(n)]


def _dice(n: int) -> list[int]:
    rng = random.Random(7)
    return [rng.choice([1, 2, 2, 3, 3, 4]) + rng.choice([1, 3, 5, 7, 9, 11]) for _ in range(n)]


SPECIAL: dict[int, Callable[[int], object]] = {
    11: _primes, 12: lambda n: [b - a for a, b in zip([0, *_primes(n)], _primes(n))], 17: _sieve,
    18: lambda n: _self_reference(n, [0, 1], lambda g, i: 1 + g[i - g[g[i - 1]]], 2), 19: _recaman,
    49: lambda n: [round(t, 4) for t in islice(accumulate(repeat(PHI), initial=0), n)], 52: _motzkin, 55: _bell, 59: _alternating,
    60: lambda n: list(islice(_bits(), n)), 69: _delay, 71: lambda n: [2**p - 1 for p in (2, 3, 5, 7, 13, 17, 19, 31)][:n],
    72: lambda n: [6, 28, 496, 8128, 33550336][:n],
    76: lambda n: sorted(
        {math.isqrt(a * a + b * b) for a in range(1, 10 * n) for b in range(a, 10 * n) if math.isqrt(a * a + b * b) ** 2 == a * a + b * b}
    )[:n],
    78: lambda n: [Fraction(1)][:n],
    80: lambda n: sorted({Fraction(a, b) for b in range(1, 9) for a in range(b + 1)})[:n], 81: lambda n: _automaton(n, 30),
    82: lambda n: _automaton(n, 90), 83: _life, 84: _sandpile, 85: _xorshift, 88: _distances, 89: _rewriting,
    92: lambda n: _self_reference(n, [0, 1, 1], lambda q, i: q[i - q[i - 1]] + q[i - q[i - 2]], 3),
    93: lambda n: _self_reference(n, [0], lambda g, i: i - g[g[i - 1]], 1), 94: _dice,
    97: lambda n: islice(_convergents(lambda i: 2 if i == 0 else 2 * (i // 3 + 1) if i % 3 == 2 else 1), n), 98: _ant,
}


def _bits() -> Iterator[int]:
    """Ten seed bits, then the exclusive or of the last two."""
    a, b = None, None
    for bit in (1, 1, 0, 1, 0, 0, 1, 0, 1, 1):
        a, b = b, bit
        yield bit
    while True:
        a, b = b, a ^ b
        yield b


def values(pattern: int, n: int) -> list[object]:
    """The first n values of a sequence; fewer where it ends."""
    if pattern in CLOSED:
        return [CLOSED[pattern](i, n) for i in range(n)]
    if pattern in RECURRENCE:
        start, step, show = RECURRENCE[pattern]
        return [show(s) for s in islice(accumulate(repeat(None), lambda s, _: step(s), initial=start), n)]
    if pattern in CYCLES:
        table, lift = CYCLES[pattern]
        return [v + lift * (i // len(table)) for i, v in zip(range(n), cycle(table))]
    if pattern in SPECIAL:
        return list(SPECIAL[pattern](n))
    raise ValueError(f"no sequence {pattern}")


def _double(v: object) -> float | None:
    try:
        return float(v)
    except OverflowError:
        return None


def long_table(spark: SparkSession, n: int = 12, patterns: list[int] | None = None) -> DataFrame:
    """(pattern_id, index, value, number) of all or some sequences: text and double of each value; the double is null beyond its range. One
    sequence is one unit of work. Sequence 9 doubles its digits with each term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (p, i, str(float(v)) if isinstance(v, Fraction) else str(v), _double(v)) for p in batch.column(0).to_pylist() for i,
                v in enumerate(values(p, n))
            ]
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.float64()))],
                ["pattern_id", "index", "value", "number"]
            )

    ids = spark.range(1, 101)
    return (
        ids if patterns is None else ids.where(F.col("id").isin(*patterns))
    ).mapInArrow(run, "pattern_id int, index int, value string, number double")


def wide_table(spark: SparkSession, n: int = 12) -> DataFrame:
    """(pattern_id, v0, v1, ...)."""
    return long_table(spark, n).groupBy("pattern_id").pivot("index", list(range(n))).agg(F.first("value")).select(
        "pattern_id", *[F.col(str(i)).alias(f"v{i}") for i in range(n)]
    )
