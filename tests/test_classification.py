"""Folds that are fitted side by side judge every row once, and alike however the rows come."""

import numpy as np

from cadenza.operators import models


def test_forests_do_not_depend_on_the_parts_of_the_table(spark):
    rng = np.random.default_rng(14)
    rows = [(k, "ab"[k % 2], *(rng.standard_normal(3) + (k % 2)).tolist()) for k in range(120)] + [(500, "c", 0.0, 0.0, 0.0), (501, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "piece_id long, era string, x double, y double, z double")
    got = [
        {(r["label"], r["predicted"]): r["n"] for r in models.classify(d, ["x", "y", "z"], "era", trees=5).collect()}
        for d in (df.coalesce(1), df.repartition(7, "x").orderBy("y"))
    ]
    assert got[0] == got[1] and sum(got[0].values()) == 120 and {k[0] for k in got[0]} == {"a", "b"}
    assert sum(n for (a, b), n in got[0].items() if a == b) > 80
