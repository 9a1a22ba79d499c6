"""Queries of the table verbs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.columns import sql_round as R
from ..operators import relational as op
from ..sources import views
from ..sources.views import NOTES_SQL, PIECES_SQL, table


def _cust(s, d):
    return table(s, d, "customer")


def _ord(s, d):
    return table(s, d, "orders")


QUERIES = {
    "inner_join": lambda s, d: rounded(
        _ord(s, d).join(_cust(s, d), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(
            F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean_price")
        ),
        4
    ),
    "left_join": lambda s, d: _cust(s, d).join(
        _ord(s, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left"
    ).groupBy(F.coalesce("n", F.lit(0)).alias("orders")).agg(F.count("*").alias("customers")),
    "semi_join": lambda s, d: _cust(s, d).join(_ord(s, d), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name"),
    "anti_join": lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "source"),
    "range_join": lambda s, d: op.near_in_time(table(s, d, "events"), 600.0),
    "union_keep_last": lambda s, d: op.keep_last(
        _ord(s, d), _ord(s, d).withColumn("o_orderstatus", F.lower("o_orderstatus")), "o_custkey", "o_orderkey"
    ).select("o_custkey", "o_orderkey", "o_orderstatus"),
    "pivot": lambda s, d: table(s, d, "events").groupBy("user_id").pivot("event_type", list(views.VOICES)).count().na.fill(0),
    "unpivot": lambda s, d: rounded(
        table(s, d, "part").select(
            "p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")
        ).unpivot(["p_partkey"], ["size", "price"], "feature", "value"),
        4
    ),
    "top_per_group": lambda s, d: _ord(s, d).withColumn(
        "k", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    ).where("k <= 5").select("o_orderpriority", "o_orderkey", "k"),
    "top_global": lambda s, d: _ord(s, d).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey"),
    "tail_rows": lambda s, d: op.tail(_ord(s, d).select("o_orderkey"), 20, ["o_orderkey"]),
    "stride_sample": lambda s, d: op.every(views.notes(s, d), 7).select("piece_id", "seq", "pitch"),
    "percentiles": lambda s, d: rounded(
        views.notes(s, d).groupBy("event_type").agg(
            F.percentile("value", 0.25).alias("q1"), F.percentile("value", 0.5).alias("median"), F.percentile("value", 0.75).alias("q3")
        )
    ),
    "histogram": lambda s, d: op.histogram(table(s, d, "events"), "value", 0.0, 500.0, 25),
    "rollup_counts": lambda s, d: views.pieces(s, d).rollup("era", "composer").agg(F.count("*").alias("pieces")),
    "value_counts": lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")),
    "running_sum": lambda s, d: rounded(
        views.notes(s, d).select(
            "piece_id", "seq",
            F.sum("pitch").over(Window.partitionBy("piece_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)).alias("total")
        )
    ),
    "tumbling_blocks": lambda s, d: rounded(
        views.notes(s, d).groupBy("piece_id", F.floor(F.col("seq") / 8).alias("block")).agg(
            F.avg("pitch").alias("mean_pitch"), F.count("*").alias("n")
        )
    ),
    "sections": lambda s, d: op.sections(views.notes(s, d), 30),
    "page_links": lambda s, d: op.links(table(s, d, "pages")),
    "track_ids": lambda s, d: table(s, d, "part").select(
        "p_partkey", op.track_id(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name")).alias("track_id")
    ),
    "composer_from_path": lambda s, d: table(s, d, "documents").select(
        "doc_id",
        op.composer_of(
            F.concat_ws(
                "/", F.element_at(F.array(F.lit("BACH"), F.lit("chopin"), F.lit("x"), F.lit("Debussy")), (F.col("doc_id") % 4 + 1).cast("int")),
                "source"
            )
        ).alias("composer")
    ).withColumn("era", op.era_of(F.col("composer"))),
    "quality_flags": lambda s, d: rounded(op.quality_flags(views.notes(s, d), 60, 70.0)),
    "pitch_time_grid": lambda s, d: op.pitch_time_grid(views.notes(s, d)),
    "interpretation_bands": lambda s, d: rounded(
        views.notes(s, d).groupBy("piece_id").agg((F.stddev_pop("pitch") / 40).alias("x")).select(
            "piece_id", op.band(F.col("x")).alias("band"), op.squash(F.col("x")).alias("squashed")
        )
    ),
}
ORACLE_SQL = {
    "inner_join": f"SELECT c_mktsegment, count(*) AS orders, {R('avg(o_totalprice)', 'mean_price', 4)} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "left_join": "SELECT coalesce(n, 0) AS orders, count(*) AS customers FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) AS o ON c_custkey = o_custkey GROUP BY 1",
    "semi_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "anti_join": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "range_join": "SELECT x.user_id, x.event_id AS a, y.event_id AS b FROM events AS x JOIN events AS y ON x.user_id = y.user_id AND (y.ts > x.ts OR (y.ts = x.ts AND y.event_id > x.event_id)) AND epoch_us(y.ts) - epoch_us(x.ts) < 600000000",
    "union_keep_last": "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY age DESC, o_orderkey DESC) AS k FROM (SELECT o_custkey, o_orderkey, o_orderstatus, 0 AS age FROM orders UNION ALL SELECT o_custkey, o_orderkey, lower(o_orderstatus), 1 FROM orders) AS u) AS v WHERE k = 1",
    "pivot": "SELECT user_id, " + ", ".join(
        f"count(*) FILTER (WHERE event_type = '{v}') AS {v}" for v in views.VOICES
    ) + " FROM events GROUP BY user_id",
    "unpivot": f"SELECT p_partkey, feature, {R('value', 'value', 4)} FROM (SELECT p_partkey, 'size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part) AS u",
    "top_per_group": "SELECT o_orderpriority, o_orderkey, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) AS r WHERE k <= 5",
    "top_global": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "tail_rows": "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20",
    "stride_sample": f"WITH {NOTES_SQL} SELECT piece_id, seq, pitch FROM notes WHERE seq % 7 = 0",
    "percentiles": f"WITH {NOTES_SQL} SELECT event_type, {R('quantile_cont(value, 0.25)', 'q1')}, {R('quantile_cont(value, 0.5)', 'median')}, {R('quantile_cont(value, 0.75)', 'q3')} FROM notes GROUP BY event_type",
    "histogram": "SELECT CAST(CASE WHEN value = 500 THEN 24 ELSE floor(value / 20.0) END AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1",
    "rollup_counts": f"WITH {PIECES_SQL} SELECT era, composer, count(*) AS pieces FROM pieces GROUP BY ROLLUP (era, composer)",
    "value_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "running_sum": f"WITH {NOTES_SQL} SELECT piece_id, seq, CAST(sum(pitch) OVER (PARTITION BY piece_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM notes",
    "tumbling_blocks": f"WITH {NOTES_SQL} SELECT piece_id, CAST(seq // 8 AS BIGINT) AS block, {R('avg(pitch)', 'mean_pitch')}, count(*) AS n FROM notes GROUP BY 1, 2",
    "sections": f"""WITH {NOTES_SQL}, j AS (SELECT piece_id, seq, CASE WHEN abs(pitch - lag(pitch) OVER (PARTITION BY piece_id ORDER BY seq)) > 30 THEN 1 ELSE 0 END AS j FROM notes),
s AS (SELECT piece_id, seq, CAST(sum(j) OVER (PARTITION BY piece_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM j) SELECT piece_id, section, min(seq) AS first_seq, count(*) AS notes FROM s GROUP BY 1, 2""",
    "page_links": """SELECT page_id, CAST(i - 1 AS INTEGER) AS position, l[i] AS link FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages) AS a) AS b""",
    "track_ids": r"SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(p_brand || ' ' || p_name)), '[^a-z0-9\s_-]', '', 'g'), '[\s_-]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(md5(p_name), 1, 8) AS track_id FROM part",
    "composer_from_path": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Bach' WHEN 1 THEN 'Chopin' WHEN 2 THEN 'Unknown' ELSE 'Debussy' END AS composer, CASE doc_id % 4 WHEN 0 THEN 'Baroque' WHEN 1 THEN 'Romantic' WHEN 2 THEN 'Other' ELSE 'Late Romantic' END AS era FROM documents",
    "quality_flags": f"""WITH {NOTES_SQL}, q AS (SELECT piece_id, count(*) AS notes, max(start + duration) AS total FROM notes GROUP BY piece_id), f AS (SELECT *, CASE WHEN notes < 60 THEN 'too_few_notes' WHEN total > 70 THEN 'too_long' ELSE '' END AS quality_note FROM q)
SELECT piece_id, notes, {R('total', 'total')}, quality_note, CASE WHEN quality_note = '' THEN 1 ELSE 0 END AS quality_flag FROM f""",
    "pitch_time_grid": f"""WITH {NOTES_SQL}, t AS (SELECT *, max(start + duration) OVER (PARTITION BY piece_id) AS total FROM notes),
c AS (SELECT piece_id, pitch - 21 AS key, unnest(range(least(CAST(floor(start / total * 50) AS INTEGER), 49), least(CAST(floor((start + duration) / total * 50) AS INTEGER), 49) + 1)) AS col FROM t WHERE pitch BETWEEN 21 AND 108)
SELECT piece_id, key, CAST(col AS INTEGER) AS column, count(*) AS n FROM c GROUP BY ALL""",
    "interpretation_bands": f"WITH {NOTES_SQL}, x AS (SELECT piece_id, stddev_pop(pitch) / 40 AS x FROM notes GROUP BY piece_id) SELECT piece_id, CASE WHEN x < 0.3 THEN 'low' WHEN x < 0.6 THEN 'moderate' ELSE 'high' END AS band, {R('1 / (1 + power(2.718, x * -0.6))', 'squashed')} FROM x",
}
