"""Chunked jobs that fail, resume and merge; as-of joins by slices of time; searches by every measure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import chunks, tables
from cadenza.operators import similarity as sim


def test_a_failed_chunk_is_run_again_by_itself(spark):
    rows = spark.range(200).select((F.col("id") % 23).alias("k"), F.col("id").alias("v"))
    ran, broken = [], {2}

    def compute(part):
        out = part.groupBy("k").agg(F.sum("v").alias("total"))
        return out.withColumn("total", F.raise_error(F.lit("lost")).cast("bigint")) if compute.chunk in broken else out

    job = chunks.ChunkedJob(rows, "k", compute, 4)

    class Watched(chunks.ChunkedJob):
        def run_chunk(self, chunk):
            compute.chunk = chunk
            ran.append(chunk)
            super().run_chunk(chunk)

    compute.chunk = None
    job = Watched(rows, "k", compute, 4)
    with pytest.raises(Exception, match="lost"):
        job.resume()
    assert ran == [0, 1, 2] and {r["chunk"] for r in job.status().where("done").collect()} == {0, 1}
    with pytest.raises(RuntimeError, match="2 of 4"):
        job.merge()
    broken.clear()
    assert job.resume() == [2, 3] and job.resume() == []
    compute.chunk = None
    want = {tuple(r) for r in rows.groupBy("k").agg(F.sum("v")).collect()}
    assert {tuple(r) for r in job.merge().select("k", "total").collect()} == want
    job.run_chunk(1)  # again: replaces its own rows and no others
    assert {tuple(r) for r in job.merge().select("k", "total").collect()} == want
    kept = job.keep(4)
    plan = kept.join(kept.withColumnRenamed("total", "again").hint("merge"), "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 0  # buckets meet without a shuffle
    assert chunks.ChunkedJob(rows.limit(0), "k", lambda d: d, 2).resume() == [0, 1]


@pytest.mark.parametrize("seconds", [1, 7, 1000])
def test_as_of_by_slices_equals_a_plain_search(spark, seconds):
    rng = np.random.default_rng(seconds)
    left = [(int(k), int(t), n) for n, (k, t) in enumerate(zip(rng.integers(0, 3, 80), rng.integers(0, 60, 80)))]
    right = [(int(k), int(t), n, int(x)) for n, (k, t, x) in enumerate(zip(rng.integers(0, 3, 40), rng.integers(0, 60, 40), rng.integers(0, 9, 40)))]
    a = spark.createDataFrame([*left, (None, 5, 99)], "k int, t int, a int")
    b = spark.createDataFrame(right, "k int, u int, b int, x int")
    got = {r["a"]: (r["b"], r["x"]) for r in tables.as_of(a, b, "k", "t", "u", ["b", "x"], "b", seconds).collect()}
    want = {}
    for k, t, n in left:
        met = [(u, m, x) for q, u, m, x in right if q == k and u <= t]
        want[n] = max(met)[1:] if met else (None, None)
    assert got == want | {99: (None, None)}


def test_every_measure_ranks_as_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    pieces = {p: rng.integers(40, 90, rng.integers(9, 30)).tolist() for p in range(41)}
    notes = spark.createDataFrame([(p, k, x) for p, v in pieces.items() for k, x in enumerate(v)], "piece_id long, seq int, pitch int")
    scores = {
        "pearson": lambda a, b: (np.corrcoef(a[: min(len(a), len(b))], b[: min(len(a), len(b))])[0, 1] + 1) / 2,
        "lcs": lambda a, b: sim.lcs(a, b) / max(len(a), len(b)),
        "dtw": lambda a, b: max(0.0, 1 - sim.dtw(a, b) / (len(a) + len(b))),
    }
    for name, score in scores.items():
        got = {(r["query"], r["rank"]): (r["piece_id"], r["similarity"]) for r in sim.similar_tracks_by(notes, notes.where("piece_id % 20 = 0"), name, top=4, part_pieces=7).collect()} if name != "dtw" else {
            (r["query"], r["rank"]): (r["piece_id"], r["similarity"]) for r in sim.similar_tracks_by(notes, notes.where("piece_id % 20 = 0"), name, top=4).collect()
        }
        want = {}
        for q in (0, 20, 40):
            rows = sorted((-round(score(np.diff(x).astype(float), np.diff(pieces[q]).astype(float)), 9), p) for p, x in pieces.items() if p != q and len(x) >= 10)
            want |= {(q, k + 1): (p, -s) for k, (s, p) in enumerate(rows[:4])}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-9 for k in want), name


def test_delimited_text_gives_back_any_text_and_cuts_files_at_lines(spark, tmp_path):
    from cadenza.sources import files

    texts = ["\\N", "\\n", "a\nb", "c\r\nd\\", "", None, 'quoted "x", y', "\\\\n", "\\", " lead"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    files.write_csv(df, f"{tmp_path}/c")
    back = files.read_csv(spark, f"{tmp_path}/c", df.schema)
    assert {r["id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))
    (tmp_path / "f.csv").write_text('id,text\n1,"two\nlines"\n2,C:\\new\n')
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/f.csv", df.schema, foreign=True).orderBy("id").collect()] == [(1, "two\nlines"), (2, "C:\\new")]


def test_a_run_goes_on_from_the_step_that_failed(spark):
    from cadenza.operators.runs import Run, Step

    broken = [True]

    def second(first):
        return first.select(F.when(F.lit(broken[0]), F.raise_error(F.lit("lost"))).otherwise(F.col("id") * 2).cast("bigint").alias("twice"))

    steps = [
        Step("first", (), lambda: spark.range(5)), Step("other", (), lambda: spark.range(2)), Step("second", ("first",), second),
        Step("both", ("second", "other"), lambda a, b: a.select(F.lit(b.count()).alias("n"), "twice")),
    ]
    run = Run(spark, steps)
    with pytest.raises(Exception, match="lost"):
        run.resume()
    assert run.done("first") and run.done("other") and not run.done("second") and not run.done("both")
    broken[0] = False
    assert Run(spark, steps, run.folder).resume() == ["second", "both"] and run.resume() == []
    assert sorted(r["twice"] for r in run.table("both").collect()) == [0, 2, 4, 6, 8]
    with pytest.raises(ValueError, match="no earlier"):
        Run(spark, [Step("a", ("b",), lambda b: b)])
