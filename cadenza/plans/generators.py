"""Queries of the number sequences."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..operators import generators as op

#: Sequences whose terms SQL has a short form for.
_SQL = {
    22: "220.0 * (i + 1)", 25: "sin(2 * pi() * 5 * i / 100.0)", 26: "sin(3 * (2 * pi() * i / 12.0))",
    30: "cos(2 * pi() * 5 * (i / 100.0)) + cos(2 * pi() * 5.5 * (i / 100.0))", 36: "power(2, bit_count(CAST(i AS BIGINT)))",
    38: "bit_count(CAST(i AS BIGINT)) % 2",
    43: "power(2, (i % 12) / 12.0)", 46: "power(2, (i % 41) / 41.0)", 56: "xor(i, i >> 1)",
    57: "1 - 2 * (bit_count(CAST(i & (i >> 1) AS BIGINT)) % 2)", 61: "i + 0.5", 63: "abs(sin(3 * (2 * pi() * i / 12.0)))",
    75: "list_sum(list_filter(range(1, i + 2), lambda d: (i + 1) % d = 0))",
    77: "i % 60", 79: "i", 90: "floor((i + 1) * (1 + sqrt(5)) / 2) - floor(i * (1 + sqrt(5)) / 2) - 1", 100: "i",
}

QUERIES = {
    "number_sequences": lambda s, d: rounded(op.long_table(s)),
    "number_sequences_wide": lambda s, d: op.wide_table(s),
    "number_sequences_closed": lambda s, d: rounded(op.long_table(s, 12, list(_SQL)).select("pattern_id", "index", "number")),
    "number_sequences_linear": lambda s, d: op.long_table(s, 30, [1, 2, 5, 6]).select(
        "pattern_id", "index", F.col("number").cast("bigint").alias("number")
    ),
}
ORACLE_SQL = {
    "number_sequences_closed": " UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS pattern_id, CAST(i AS INTEGER) AS index, {R(e, 'number')} FROM (SELECT unnest(range(12)) AS i) AS r{k}" for k,
        e in _SQL.items()
    ),
    "number_sequences_linear": """WITH RECURSIVE r AS (SELECT p, 0 AS i, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, x, y FROM (VALUES (1, 1, 1, 1, 1), (2, 2, 1, 1, 1), (5, 0, 1, 1, 2), (6, 0, 1, 2, 1)) AS v(p, a, b, x, y)
UNION ALL SELECT p, i + 1, b, x * a + y * b, x, y FROM r WHERE i < 29) SELECT CAST(p AS INTEGER) AS pattern_id, CAST(i AS INTEGER) AS index, a AS number FROM r""",
}
