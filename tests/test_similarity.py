"""Searches take every query, in blocks, and the index finds what the exact search finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import similarity as sim
from cadenza.plans import catalog


def test_nearest_takes_more_queries_than_a_block_holds(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = v.where("vec_id % 20 = 0")
    rows = lambda n: sorted(tuple(r) for r in sim.nearest(v, q, part_rows=n).select("query", "neighbour", "rank", "score").collect())
    assert rows(7) == rows(1000) and len(rows(7)) == 10 * q.count()


def test_registered_searches_take_every_twentieth_row(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 20 = 0")
    assert {r[0] for r in catalog.QUERIES["lsh_search"](spark, sf_dir).select("query").collect()} == {r[0] for r in v.select("vec_id").collect()}
    found = catalog.QUERIES["alignment_similarity"](spark, "/root/testdata/sf0.01").select("query").distinct().collect()
    assert len(found) > 1 and all(r[0] % 20 == 0 for r in found)


def test_alignment_in_blocks_equals_each_query_by_itself(spark):
    rng = np.random.default_rng(2)
    notes = spark.createDataFrame(
        [(p, k, int(x)) for p, n in ((0, 12), (1, 15), (2, 9), (20, 11)) for k, x in enumerate(rng.integers(50, 70, n))],
        "piece_id long, seq int, pitch int"
    )
    rows = lambda q, n: sorted(tuple(r) for r in sim.align_to(notes, notes.where(q), block_queries=n).collect())
    both = rows("piece_id % 20 = 0", 1)
    assert both == rows("piece_id % 20 = 0", 100) == sorted(rows("piece_id = 0", 9) + rows("piece_id = 20", 9))
    assert [r[:2] for r in both] == [(0, 1), (0, 20), (20, 0), (20, 1)]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01", "sf0.1"])
def test_index_finds_nine_of_ten_nearest(spark, folder):
    v = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    q = v.where(F.col("vec_id") % 20 == 0)
    pairs = lambda d: {tuple(r) for r in d.select("query", "neighbour").collect()}
    exact = pairs(sim.nearest(v, q))
    recall = len(exact & pairs(sim.lsh_search(v, q))) / len(exact)
    print(folder, "recall", recall)
    assert recall >= 0.9
