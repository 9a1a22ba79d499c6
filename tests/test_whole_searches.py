"""Searches that take every row as a query."""

from cadenza.plans import catalog


def test_warping_search_asks_for_every_piece(spark, sf_dir):
    pieces = {r[0] for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().collect()}
    found = catalog.QUERIES["warping_search"](spark, sf_dir).collect()
    assert {r["query"] for r in found} == pieces and len(found) == len(pieces) * min(10, len(pieces) - 1)
