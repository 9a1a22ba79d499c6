"""Interleaving against brute force, the mixture with many small sources, equal rows, and files."""

from collections import Counter

from pyspark.sql import functions as F

from cadenza.llm import sharding

SCHEMA = "doc_id long, text string, source string"


def brute_force(spark, rows, shards, seed=7):
    """Positions by plain sorting; only the seeded hashes come from Spark."""
    sign = F.lit(-(1 << 63))
    keyed = [(i, "" if s is None else "=" + s, len((t or "").encode()) + 1, t or "") for i, t, s in rows]
    frame = spark.createDataFrame(keyed, "id long, source string, size long, t string").withColumn("crc", F.crc32(F.col("t").cast("binary")))
    got = frame.withColumns(
        {"h": F.xxhash64(F.lit(seed), "id", "size", "crc").bitwiseXOR(sign), "hs": F.xxhash64(F.lit(seed), "source").bitwiseXOR(sign)}
    ).collect()
    counts = Counter(r.source for r in got)
    starts = {
        r.n: r.x for r in spark.createDataFrame([(n,) for n in set(counts.values())], "n long").withColumn(
            "x", F.pmod(F.xxhash64(F.lit(seed + 1), "n"), F.lit(1 << 30)) / float(1 << 30)
        ).collect()
    }
    phase = {}
    for n in set(counts.values()):
        alike = sorted({(r.hs, r.source) for r in got if counts[r.source] == n})
        phase |= {s: (k + starts[n]) / len(alike) for k, (_, s) in enumerate(alike)}
    placed = []
    for s, n in counts.items():
        own = sorted((r.h, r.id, r.size, r.crc) for r in got if r.source == s)
        placed += [((k + phase[s]) / n, h, s, i, size, crc) for k, (h, i, size, crc) in enumerate(own)]
    out, total = [], len(placed)
    for position, (_, _, s, i, size, crc) in enumerate(sorted(placed)):
        shard = position * shards // total
        out.append((i, s[1:] if s else None, size, crc, shard, position - -(-shard * total // shards)))
    return sorted(out, key=str)


def test_places_are_those_of_plain_sorting(spark):
    sources = ["hot"] * 700 + ["a"] * 90 + ["b"] * 90 + [None] * 31 + [f"one{k}" for k in range(300)] + [f"two{k // 2}" for k in range(80)]
    rows = [(i if i % 9 else None, None if i % 50 == 0 else f"text {i % 7} é", s) for i, s in enumerate(sources)]
    want = brute_force(spark, rows, 8)
    for bucket_rows in (4, 2048):
        found = sharding.interleave(spark.createDataFrame(rows, SCHEMA), 8, bucket_rows=bucket_rows).collect()
        assert sorted(map(tuple, found), key=str) == want


def test_a_large_source_is_spread_evenly_among_thousands_of_single_rows(spark):
    rows = [(i, f"t{i}", f"s{i}") for i in range(8000)] + [(8000 + i, f"u{i}", "big") for i in range(1000)]
    found = sharding.interleave(spark.createDataFrame(rows, SCHEMA), 8).collect()
    own = Counter(r.shard for r in found if r.source == "big")
    assert set(Counter(r.shard for r in found).values()) == {1125} and all(abs(own[k] - 125) <= 2 for k in range(8)), own


def test_equal_rows_are_dealt_over_tasks_and_get_slots_of_their_own(spark):
    rows = [(1, "same", "x")] * 3000 + [(None, None, None)] * 900 + [(i, "other", "x") for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sharding.interleave(docs, 8, bucket_rows=16).collect()
    counts = Counter(r.shard for r in found)
    assert len(found) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in found if r.shard == k) == list(range(counts[k])) for k in range(8))
    kinds = Counter((r.id, r.size, r.source) for r in found)
    assert kinds[(1, 5, "x")] >= 3000 and kinds[(None, 1, None)] == 900
    own = Counter(r.shard for r in found if r.source is None)
    assert all(abs(own[k] - 900 / 8) <= 2 for k in range(8))


def test_files_carry_columns_of_any_name(spark, tmp_path):
    rows = [(i, f"t{i % 3}", f"s{i % 5}", f"own{i}", 7, 8, 9) for i in range(60)] + [(3, "t0", "s3", "twice", 1, 1, 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _id string, _shard int, n int, `a.b` int")
    sharding.write_shards(docs, f"{tmp_path}/s", 4, file_rows=5)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(tuple, back.select(*[f"`{c}`" for c in docs.columns]).collect())) == sorted(rows)
    assert sorted(Counter(r["_shard_"] for r in back.collect()).values()) == [15, 15, 16, 16]
    sharding.write_shards(docs.limit(0), f"{tmp_path}/none", 4)
    assert sharding.interleave(docs.limit(0), 4).count() == 0
