"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF_OFFSET = 1.3e-9


def by_seq() -> Window:
    """Each piece in order. A function, since a window needs a session and workers have none."""
    return Window.partitionBy("piece_id").orderBy("seq")


def by_piece() -> Window:
    return Window.partitionBy("piece_id")


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """All double columns rounded, with no negative zero, so that results compare exactly. The offset moves exact halves, which engines round
    differently.
    """
    return df.select(
        *[(F.round(F.col(f"`{f.name}`") + HALF_OFFSET, digits) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    )


def entropy(counts: list[Column]) -> Column:
    """Shannon entropy in bits of counts; 0 if all are 0."""
    listed = F.array(*[c.cast("double") for c in counts])
    total = F.aggregate(listed, F.lit(0.0), lambda acc, c: acc + c)
    surprise = F.aggregate(listed, F.lit(0.0), lambda acc, c: acc + F.when(c > 0, c * F.log2(c)).otherwise(0.0))
    return F.when(total > 0, F.log2(total) - surprise / total).otherwise(0.0)


def share(condition: Column) -> Column:
    """Aggregate: the share of rows for which a condition holds; rows where it is null do not count."""
    return F.avg(F.when(condition, 1.0).when(~condition, 0.0))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson's correlation over the rows that have both; null where either does not vary, which corr() makes an error."""
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.when(spread > 0, spread)


def zscore(column: str, window: Window | None = None) -> Column:
    """Population z-score over a window (all rows without one); 0 where the deviation is 0."""
    w = window or Window.partitionBy()
    deviation = F.stddev_pop(column).over(w)
    return F.coalesce((F.col(column) - F.avg(column).over(w)) / F.when(deviation != 0, deviation), F.lit(0.0))


def is_prime(n: Column) -> Column:
    """Trial division up to the square root, for integers of moderate size."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("int")
    return F.when(n < 2, False).when(n < 4, True).otherwise(F.forall(F.sequence(F.lit(2), F.greatest(root, F.lit(2))), lambda d: n % d != 0))


def sql_round(expression: str, name: str, digits: int = 7) -> str:
    """What rounded() does, in SQL."""
    return f"round(CAST({expression} AS DOUBLE) + {HALF_OFFSET}, {digits}) + 0.0 AS {name}"
