"""Cross-piece statistics: z-scores, signatures, group summaries, profiles, distances, tests, histograms.

Inputs are feature tables with one row per piece. Global moments are aggregates that come back as one row, so no step sorts or gathers all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correlation as correlated

SIGNATURE_INPUTS = (
    "pitch_range", "pitch_std", "repetition_index", "consonance_score", "dissonance_index", "pitch_entropy", "interval_entropy", "rhythmic_entropy",
    "spectral_entropy", "fractal_dimension"
)
SIGNATURES = ("sig_melodic_volatility", "sig_motif_repetition", "sig_consonance_balance", "sig_structural_complexity")


def with_zscores(df: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Adds population z-scores; a column without variation gets 0. The moments are one row and are sent to all tasks."""
    moments = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {f"{prefix}{c}": F.when(F.col(f"_s_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}
    return df.crossJoin(F.broadcast(moments)).withColumns(z).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def signature_scores(matrix: DataFrame) -> DataFrame:
    """Four scores from z-scores; the consonance balance is z(consonance) - z(dissonance)."""
    z = with_zscores(matrix, SIGNATURE_INPUTS)
    c = F.col
    return z.select(
        "piece_id", *[x for x in ("composer", "era") if x in matrix.columns], ((c("z_pitch_range") + c("z_pitch_std")) / 2).alias(SIGNATURES[0]),
        c("z_repetition_index").alias(SIGNATURES[1]),
        (c("z_consonance_score") - c("z_dissonance_index")).alias(SIGNATURES[2]),
        (
            (c("z_pitch_entropy") + c("z_interval_entropy") + c("z_rhythmic_entropy") + c("z_spectral_entropy") + c("z_fractal_dimension")) / 5
        ).alias(SIGNATURES[3]),
    )


def aesthetic_index(df: DataFrame, third: str = "rw_corr_z") -> DataFrame:
    """(piece_id, aesthetic_z_raw, aesthetic_index): z-scores of prime sums, golden density and a third column by .25, .25 and .5, and the same
    scaled to 0..1 over all pieces; 0.5 if all are equal.
    """
    z = with_zscores(df, ("prime_sum_ratio", "phi_density_ratio", third))
    raw = z.select(
        "piece_id", (0.25 * F.col("z_prime_sum_ratio") + 0.25 * F.col("z_phi_density_ratio") + 0.5 * F.col(f"z_{third}")).alias("aesthetic_z_raw")
    )
    bounds = raw.agg(F.min("aesthetic_z_raw").alias("lo"), F.max("aesthetic_z_raw").alias("hi"))
    index = F.when(F.col("hi") > F.col("lo"), (F.col("aesthetic_z_raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.5)
    return raw.crossJoin(F.broadcast(bounds)).select("piece_id", "aesthetic_z_raw", index.alias("aesthetic_index"))


def group_summary(df: DataFrame, by: str, columns: Sequence[str], least_rows: int) -> DataFrame:
    """Mean, sample deviation and count of each column, for groups of at least ``least_rows`` rows."""
    stats = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("count", F.count))]
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n_pieces"), *stats).where(F.col("n_pieces") >= least_rows)


def profiles(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, feature, mean, std, min, max, median): population deviation, long form."""
    long = df.unpivot([by], list(columns), "feature", "value").where(F.col("value").isNotNull())
    return long.groupBy(by, "feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.percentile("value", 0.5).alias("median")
    )


def profile_distances(profile: DataFrame, by: str) -> DataFrame:
    """(a, b, distance) for each two groups: mean over features of |difference of means| / mean deviation, each at most 10. Groups are few and
    meet on the feature.
    """
    a = profile.select("feature", F.col(by).alias("a"), F.col("mean").alias("ma"), F.col("std").alias("sa"))
    b = profile.select("feature", F.col(by).alias("b"), F.col("mean").alias("mb"), F.col("std").alias("sb"))
    term = F.least(F.abs(F.col("ma") - F.col("mb")) / ((F.col("sa") + F.col("sb")) / 2 + 1e-8), F.lit(10.0))
    return a.join(b, "feature").where("a < b").groupBy("a", "b").agg(F.avg(term).alias("distance"))


def closest_group(df: DataFrame, profile: DataFrame, by: str, columns: Sequence[str], id_col: str = "piece_id") -> DataFrame:
    """(id, closest, score): the group with the least mean |x - mean| / deviation over features that vary in it; ties by name."""
    long = df.unpivot([id_col], list(columns), "feature", "value")
    scored = long.join(profile.where("std > 1e-9"), "feature").groupBy(id_col, by).agg(
        F.avg(F.abs(F.col("value") - F.col("mean")) / F.col("std")).alias("score")
    )
    best = scored.groupBy(id_col).agg(F.min(F.struct(F.round("score", 9).alias("score"), F.col(by).alias("g"))).alias("x"))
    return best.select(id_col, F.col("x.g").alias("closest"), F.col("x.score").alias("score"))


def anova(df: DataFrame, by: str, column: str, least_rows: int = 2) -> DataFrame:
    """One row: F statistic and degrees of freedom of a one-way analysis of variance, from group sums alone."""
    groups = df.where(F.col(by).isNotNull() & F.col(column).isNotNull()).groupBy(by).agg(
        F.count("*").cast("double").alias("n"), F.avg(column).alias("m"), F.var_pop(column).alias("v")
    ).where(F.col("n") >= least_rows)
    total = groups.agg(
        F.sum("n").alias("n"), F.count("*").cast("double").alias("k"), F.sum(F.col("n") * F.col("m")).alias("nm"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("v")).alias("within")
    )
    between = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n")
    return total.select(
        F.lit(column).alias("feature"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"),
        ((between / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f_statistic")
    )


def anova_of(df: DataFrame, by: str, columns: Sequence[str], least_rows: int = 2) -> DataFrame:
    """anova() of several columns, in one pass: a row for each."""
    long = df.where(F.col(by).isNotNull()).select(
        by, *[F.col(c).cast("double").alias(c) for c in columns]
    ).unpivot([by], list(columns), "feature", "value").where("value is not null")
    groups = long.groupBy("feature", by).agg(
        F.count("*").cast("double").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    ).where(F.col("n") >= least_rows)
    sums = [F.sum("n").alias("n"), F.count("*").cast("double").alias("k"), F.sum(F.col("n") * F.col("m")).alias("nm")]
    total = groups.groupBy("feature").agg(
        *sums, F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nmm"), F.sum(F.col("n") * F.col("v")).alias("within")
    )
    between, inner, outer = F.col("nmm") - F.col("nm") * F.col("nm") / F.col("n"), F.col("k") - 1, F.col("n") - F.col("k")
    return total.select(
        "feature", inner.alias("df_between"), outer.alias("df_within"), ((between / inner) / (F.col("within") / outer)).alias("f_statistic")
    )


def t_test(df: DataFrame, by: str, column: str, first: str, second: str) -> DataFrame:
    """One row: pooled two-sample t statistic and degrees of freedom."""
    moments = [
        f(F.when(F.col(by) == g, F.col(column))).alias(f"{n}{i}") for i, g in enumerate((first, second)) for n,
        f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))
    ]
    c = F.col
    pooled = ((c("n0") - 1) * c("v0") + (c("n1") - 1) * c("v1")) / (c("n0") + c("n1") - 2)
    return df.agg(*moments).select(
        F.lit(column).alias("feature"), (c("n0") + c("n1") - 2).cast("double").alias("df"),
        ((c("m0") - c("m1")) / F.sqrt(pooled * (1 / c("n0") + 1 / c("n1")))).alias("t_statistic")
    )


def one_sample_t(df: DataFrame, column: str, expected: float) -> DataFrame:
    """One row: t statistic of a column's mean against an expected value."""
    n = F.count(column)
    return df.agg(n.cast("double").alias("n"), ((F.avg(column) - expected) / (F.stddev_samp(column) / F.sqrt(n.cast("double")))).alias("t_statistic"))


def correlation(df: DataFrame, x: str, y: str) -> Column:
    return df.agg(correlated(F.col(x), F.col(y)).alias("r"), F.count("*").alias("n"))


def kl_divergence(original: DataFrame, other: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """One row: sum of x log(x / y) - x + y over density histograms on the first sample's range (last bin closed), each density plus 1e-8.
    Values of the second sample outside the range do not count.
    """
    bounds = original.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))

    def density(df: DataFrame, name: str) -> DataFrame:
        at = F.when(F.col(column) == F.col("hi"), bins - 1).otherwise(F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)))
        rows = df.select(column).crossJoin(F.broadcast(bounds)).where((F.col(column) >= F.col("lo")) & (F.col(column) <= F.col("hi")))
        counts = rows.select(
            at.cast("int").alias("bin"), ((F.col("hi") - F.col("lo")) / bins).alias("w")
        ).groupBy("bin").agg(F.count("*").alias("c"), F.max("w").alias("w"))
        total = counts.agg(F.sum("c").alias("t"))
        return counts.crossJoin(F.broadcast(total)).select("bin", (F.col("c") / F.col("t") / F.col("w")).alias(name))

    every = original.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(density(original, "p"), "bin", "left").join(density(other, "q"), "bin", "left")
    x, y = F.coalesce("p", F.lit(0.0)) + 1e-8, F.coalesce("q", F.lit(0.0)) + 1e-8
    return joined.agg(F.sum(x * F.log(x / y) - x + y).alias("kl"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, from which p-values of t, F and r follow."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_p_value(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_p_value(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def r_p_value(r: float, n: int) -> float:
    return 0.0 if abs(r) >= 1 else t_p_value(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


#: Weights of the beauty terms before they are fitted.
BEAUTY = {"pitch_entropy": 0.35, "consonance_score": 0.25, "repetition_index": 0.2, "fractal_dimension": 0.2}


def beauty_weights(df: DataFrame, liked: str, weights: dict[str, float] = BEAUTY, significant: float = 0.05) -> DataFrame:
    """(feature, r, p, weight): weights of features by their correlation with a liking: |r| as a share of all significant ones, the others as
    they were, all brought to a sum of one.
    """
    moments = df.agg(*[correlated(F.col(c), F.col(liked)).alias(c) for c in weights], F.count("*").alias("_n")).first()
    r = {c: moments[c] if moments[c] is not None and moments[c] == moments[c] else 0.0 for c in weights}
    p = {c: r_p_value(r[c], moments["_n"]) if moments["_n"] > 2 else 1.0 for c in weights}
    strong = {c: abs(r[c]) for c in weights if p[c] < significant}
    total = sum(strong.values()) or 1.0
    raw = {c: strong[c] / total if c in strong else w for c, w in weights.items()}
    whole = sum(raw.values()) or 1.0
    return df.sparkSession.createDataFrame(
        [(c, float(r[c]), float(p[c]), raw[c] / whole) for c in weights], "feature string, r double, p double, weight double"
    )


def impact_score(
    matrix: DataFrame, entropy_band: tuple[float, float] = (2.0, 2.8), consonance: float = 0.65, repetition: float = 0.4, fractal: float = 1.5,
    weights: tuple[float, float, float, float] = (0.35, 0.25, 0.2, 0.2)
) -> DataFrame:
    """(piece_id, impact): pitch entropy inside a band, and closeness of consonance, repetition and fractal dimension to targets, weighted and
    held to 0..1.
    """
    lo, hi = entropy_band
    e = F.col("pitch_entropy")
    inside = F.when((e >= lo) & (e <= hi), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.abs(e - lo), F.abs(e - hi))))
    parts = [
        inside,
        *[1 - F.abs(F.col(c) - t) for c, t in (("consonance_score", consonance), ("repetition_index", repetition), ("fractal_dimension", fractal))]
    ]
    total = sum((p * w for p, w in zip(parts[1:], weights[1:])), parts[0] * weights[0])
    return matrix.select("piece_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("impact"))
