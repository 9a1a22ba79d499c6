"""Number-theoretic measures of pieces: golden ratio, primes, known number sets, running sums.

Input: notes (piece_id, seq, pitch, duration, start). Every measure is windows and one aggregate by piece. Pieces too short for a measure
get the constant named with it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import by_piece, by_seq, is_prime, share
from .features import with_steps

PHI = (1 + math.sqrt(5)) / 2


def additive(a: int, b: int, n: int) -> list[int]:
    """The first n terms of the sequence in which each term is the sum of the two before it."""
    out = [a, b]
    while len(out) < n:
        out.append(out[-1] + out[-2])
    return out[:n]


FIBONACCI, LUCAS = sorted(set(additive(1, 1, 25))), sorted(set(additive(2, 1, 20)))
PERFECT, TRIANGULAR = [6, 28, 496, 8128], [n * (n + 1) // 2 for n in range(1, 20)]
#: The small sides of Pythagorean triples whose ratios durations are compared with.
PYTHAGOREAN = ((3, 4), (3, 5), (4, 5), (5, 12), (5, 13), (8, 15))


def is_fibonacci(n: Column, tolerance: int = 0) -> Column:
    """Within tolerance of one of the first 30 terms; false below 1."""
    return (n >= 1) & F.exists(F.array(*[F.lit(f) for f in sorted(set(additive(1, 1, 30)))]), lambda f: F.abs(n - f) <= tolerance)


def _climax(aggregate: bool = True) -> list[Column]:
    first = F.min(F.when(F.col("pitch") == F.col("top"), F.col("seq")))
    position = first / F.count("*")
    distance = F.abs(position - 1 / PHI)
    return [position.alias("climax_position_ratio"), distance.alias("climax_golden_distance"), (distance < 0.05).alias("climax_is_golden")]


def _prepared(notes: DataFrame) -> DataFrame:
    return with_steps(notes).withColumns({
        "top": F.max("pitch").over(by_piece()), "next_duration": F.lead("duration").over(by_seq()),
        "total_pitch": F.sum("pitch").over(by_seq().rowsBetween(Window.unboundedPreceding, 0)),
        "size": F.abs(F.col("pitch") - F.lag("pitch").over(by_seq())),
    })


def _sections(n: Column, parts: int = 5) -> Column:
    """Lengths of equal parts of n, the last of which takes the remainder."""
    each = F.floor(n / parts)
    return F.array(*[each] * (parts - 1), n - each * (parts - 1))


def _golden_durations() -> Column:
    return F.coalesce(
        F.avg(F.when(F.col("next_duration") != 0, F.when(F.abs(F.col("duration") / F.col("next_duration") - PHI) < 0.1, 1.0).otherwise(0.0))),
        F.lit(0.0)
    )


def golden_ratio_structure(notes: DataFrame) -> DataFrame:
    """Climax position, sections near Fibonacci numbers (within 2), golden duration ratios, count of Fibonacci intervals."""
    n = F.count("*")
    sections = _sections(n)
    near = F.size(F.filter(sections, lambda x: is_fibonacci(x, 2))) / 5.0
    fib = F.count_if(F.col("size").isin(*FIBONACCI[:19]))
    return _prepared(notes).groupBy("piece_id").agg(
        *_climax(), near.alias("fibonacci_section_ratio"), _golden_durations().alias("golden_ratio_in_durations"), fib.alias("fibonacci_intervals")
    )


def _sixteenths() -> Column:
    return F.greatest(F.lit(1), F.rint(F.col("duration") * 4).cast("int"))


def _phrases(notes: DataFrame, closed: bool) -> DataFrame:
    """(piece_id, length) of the stretches between large intervals: above the 75th percentile, or from it on if closed."""
    steps = notes.select("piece_id", "seq", F.abs(F.col("pitch") - F.lag("pitch").over(by_seq())).alias("size"))
    steps = steps.join(steps.groupBy("piece_id").agg(F.percentile("size", 0.75).alias("limit")), "piece_id")
    cut = F.when(F.col("size") >= F.col("limit") if closed else F.col("size") > F.col("limit"), 1).otherwise(0)
    marked = steps.withColumn("phrase", F.sum(cut).over(by_seq().rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("piece_id", "phrase").agg(F.count("*").alias("length"))


def prime_structure(notes: DataFrame) -> DataFrame:
    """Shares of prime interval sizes and of durations that are a prime number of sixteenths, phrases of prime length, distinct interval sizes,
    notes.
    """
    base = _prepared(notes).groupBy("piece_id").agg(
        F.coalesce(share(is_prime(F.col("size"))), F.lit(0.0)).alias("interval_prime_density"),
        F.avg(F.when(is_prime(_sixteenths()), 1.0).otherwise(0.0)).alias("duration_prime_ratio"),
        F.count_distinct("size").alias("unique_intervals"), F.count("*").alias("total_notes"),
    )
    phrases = _phrases(notes, closed=False).groupBy("piece_id").agg(F.count_if(is_prime(F.col("length"))).alias("num_prime_phrases"))
    return base.join(phrases, "piece_id")


def prime_harmonics(notes: DataFrame, most: int = 20) -> DataFrame:
    """(piece_id, harmonic, amplitude): for each prime up to ``most``, the share of the pitch class it falls on."""
    primes = [p for p in range(2, most + 1) if all(p % d for d in range(2, p))]
    pc = F.pmod(F.col("pitch"), F.lit(12))
    rows = notes.groupBy("piece_id").agg(
        F.array(
            *[F.struct(F.lit(p).alias("harmonic"), (F.count_if(pc == p % 12) / (F.count("*") + 1e-8)).alias("amplitude")) for p in primes]
        ).alias("h")
    )
    return rows.select("piece_id", F.explode("h").alias("x")).select("piece_id", "x.*")


def known_patterns(notes: DataFrame) -> DataFrame:
    """Thirteen scores of known number patterns."""
    size, n = F.col("size"), F.count("*")
    ratio = F.greatest(F.col("duration"), F.lit(1e-6)) / F.greatest(F.col("next_duration"), F.lit(1e-6))
    close = F.exists(F.array(*[F.lit(p / q) for p, q in PYTHAGOREAN]), lambda t: F.abs(ratio - t) / t < 0.12)
    pairs = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(_sections(n)[i - 1].alias("a"), _sections(n)[i].alias("b")))
    near = F.filter(F.transform(F.filter(pairs, lambda p: p["b"] > 0), lambda p: F.abs(p["a"] / p["b"] - PHI)), lambda d: d < 0.15)
    golden = F.when((n < 10) | (F.size(near) == 0), 0.0).otherwise(F.aggregate(near, F.lit(0.0), lambda acc, d: acc + (1 - d / 0.15)) / F.size(near))
    part = lambda values: F.coalesce(share(size.isin(*values)), F.lit(0.0))
    position, distance, _ = _climax()
    base = _prepared(notes).groupBy("piece_id").agg(
        F.coalesce(share(is_prime(size)), F.lit(0.0)).alias("interval_prime_density"),
        F.avg(F.when(is_prime(_sixteenths()), 1.0).otherwise(0.0)).alias("duration_prime_ratio"),
        position, distance, F.when(_climax()[2], 1.0).otherwise(0.0).alias("climax_near_golden"), part(FIBONACCI).alias("fibonacci_interval_ratio"),
        part(LUCAS).alias("lucas_interval_ratio"),
        part(PERFECT).alias("perfect_interval_ratio"), part(TRIANGULAR).alias("triangular_interval_ratio"),
        golden.alias("golden_section_ratio_score"),
        F.coalesce(
            F.avg(F.when(F.col("next_duration").isNotNull(), F.when(close, 1.0).otherwise(0.0))), F.lit(0.0)
        ).alias("pythagorean_duration_ratio"),
        F.avg(F.when(is_prime(F.col("total_pitch")), 1.0).otherwise(0.0)).alias("cumulative_prime_ratio"), n.alias("_n"),
    )
    phrases = _phrases(notes, closed=True).groupBy("piece_id").agg(F.avg(F.when(F.col("length").isin(*FIBONACCI), 1.0).otherwise(0.0)).alias("p"))
    return base.join(phrases, "piece_id").withColumn("fibonacci_phrase_ratio", F.when(F.col("_n") < 4, 0.0).otherwise(F.col("p"))).drop("_n", "p")


def numeric_patterns(notes: DataFrame, most_lag: int = 12) -> DataFrame:
    """Prime running sums, density around golden positions, and mean absolute autocorrelation of intervals at lags below min(most_lag,
    intervals / 2).
    """
    base = _prepared(notes)
    n = F.count("*")
    half = F.least(F.greatest(F.lit(1), (n * 0.03).cast("int")), F.lit(32))
    # positions f * (n - 1), half to even, for the four golden fractions, of which two pairs coincide up to rounding
    spots = [F.rint(F.lit(f) * (n - 1)) for f in (1 / PHI, 1 / PHI**2, 1 - 1 / PHI, 1 - 1 / PHI**2)]
    spans = F.array_distinct(
        F.flatten(
            F.array(*[F.sequence(F.greatest(F.lit(0), (s - half).cast("int")), F.least(n - 1, (s + half).cast("bigint")).cast("int")) for s in spots])
        )
    )
    first = base.groupBy("piece_id").agg(
        n.alias("n_notes"), F.avg("pitch").alias("pitch_mean"), F.stddev_pop("pitch").alias("pitch_std"),
        F.avg(F.when(is_prime(F.col("total_pitch")), 1.0).otherwise(0.0)).alias("prime_sum_ratio"), (F.size(spans) / n).alias("phi_density_ratio")
    )
    iv = with_steps(notes).where(F.col("iv").isNotNull())
    w = by_piece()
    z = iv.select("piece_id", "seq", ((F.col("iv") - F.avg("iv").over(w)) / F.stddev_pop("iv").over(w)).alias("z"), F.count("*").over(w).alias("n"))
    lagged = z.select("piece_id", "n", *[(F.col("z") * F.lag("z", k).over(by_seq())).alias(f"l{k}") for k in range(1, most_lag)])
    lags = [F.when(F.lit(k) < F.least(F.lit(most_lag), F.floor(F.max("n") / 2)), F.abs(F.avg(f"l{k}"))) for k in range(1, most_lag)]
    alike = lagged.groupBy("piece_id").agg(F.array_compact(F.array(*lags)).alias("a"))
    mean = F.when(F.size("a") > 0, F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x) / F.size("a")).otherwise(0.0)
    return first.join(
        alike.select("piece_id", mean.alias("interval_self_similarity")), "piece_id", "left"
    ).withColumn("interval_self_similarity", F.coalesce("interval_self_similarity", F.lit(0.0)))
