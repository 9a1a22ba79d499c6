"""Packing against the library's encoding, the bound that the token count sets, and a plain sum of squares."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from cadenza.llm import bpe, packing


def plain_sum_of_squares(lengths, most):
    bins, out = [], []
    for length in lengths:
        def total(k, length=length):
            gaps = [g - length * (i == k) for i, g in enumerate(bins)]
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)
        room = [k for k, g in enumerate(bins) if g >= length]
        k = min(room, key=lambda k: (total(k), bins[k] - length)) if room else len(bins)
        if not room:
            bins.append(most)
        out.append(most - bins[k])
        bins[k] -= length
    return sorted(bins), out


def check_places(rows, most):
    """Every sequence is filled from 0 without gaps, up to ``most``."""
    by = {}
    for length, sequence, offset in rows:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(by)


def test_placement_is_that_of_the_plain_rule():
    rng = random.Random(3)
    for most in (7, 20, 64):
        lengths = sorted((rng.randrange(1, most) for _ in range(60)), reverse=True)
        sequence, offset = packing.sum_of_squares(np.array(lengths), most)
        bins, offsets = plain_sum_of_squares(lengths, most)
        filled = np.bincount(sequence, lengths)
        assert sorted((most - filled).astype(int)) == bins and offset.tolist() == offsets


def test_packs_close_to_the_bound_in_one_group_or_many(spark):
    rng = random.Random(4)
    lengths = [min(1024, int(rng.expovariate(1 / 400)) + 1) for _ in range(6000)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "n bigint, length bigint")
    for group, waste in ((32_768, 0.002), (500, 0.012)):
        rows = pieces.join(packing.pack(pieces, group_pieces=group), "n").select("length", "sequence_id", "offset").collect()
        assert len(rows) == 6000
        assert check_places(rows, 1024) <= (sum(lengths) / 1024) * (1 + waste) + 1
    alike = spark.range(3000).select(F.col("id").alias("n"), F.lit(600).cast("bigint").alias("length"))
    assert packing.pack(alike, group_pieces=500).select("sequence_id").distinct().count() == 3000


def test_documents_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation()
    rng = random.Random(5)
    words = ["some", "words", "é", "中", "x1", "\n", "don't", "  "]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 900, 3000]))) for _ in range(60)] + [None, "", "a", "a", "b " * 40_000]
    docs = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    clashing = docs.selectExpr("*", "1 as n", "2 as id", "3 as length", "4 as pieces")
    rows = packing.pack_documents(clashing, most=64, keep_ids=True, group_pieces=50).collect()
    assert check_places([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 64) <= sum(r["length"] for r in rows) / 64 * 1.05 + 1
    assert all(r["length"] == 64 for r in rows if r["piece"])
    want = []
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64
        cuts = [*([0] if first else []), *range(first, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((k if k % 9 else -1, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((-1 if r["id"] is None else r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    frame = spark.createDataFrame(rows)
    for r in packing.sequences(frame).collect():
        assert len(r["ids"]) <= 64 and r["starts"][0] == 0
    assert packing.sequences(frame).select(F.sum(F.size("ids")).alias("n")).first()["n"] == sum(x[3] for x in want)
    assert packing.pack_documents(docs.limit(0)).count() == 0
