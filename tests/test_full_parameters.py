"""Registered motif queries mine with the operator's full lengths and shuffles, and count over all that is mined."""

import numpy as np

from cadenza.operators import motifs
from cadenza.plans import catalog
from cadenza.sources import views


def test_motif_queries_mine_longer_motifs_and_count_all_of_them(spark, monkeypatch):
    theme = np.random.default_rng(3).integers(40, 90, 40).tolist()
    notes = spark.createDataFrame([(1, k, int(p)) for k, p in enumerate(theme * 3)], "piece_id long, seq int, pitch int").cache()
    monkeypatch.setattr(views, "motes", lambda s, d: notes)
    found = catalog.QUERIES["motif_mining"](spark, "").collect()
    assert {r.length for r in found} == set(range(3, 13)) and len(found) > 20
    every = motifs.mine(notes, 3, 12, 2, 25, None).where("z >= 2").count()
    assert [r.num_patterns_z_ge_2 for r in catalog.QUERIES["motif_summary"](spark, "").collect()] == [every] and every > 20
