"""Repeated rows in number, ids of any type and of the largest value, and text work in as many tasks as the input has."""

import random
import time

import pytest

from cadenza.llm import bpe, shared, splits, substrings


def _text(rng, n):
    return " ".join(f"w{rng.randrange(50_000)}" for _ in range(n))


def test_many_equal_rows_cost_no_square(spark):
    rng = random.Random(3)
    shared_text = _text(rng, 400)
    other = _text(rng, 30) + " " + " ".join(shared_text.split(" ")[50:200]) + " " + _text(rng, 30)
    few = [(1, shared_text), (3, other)]
    schema = "doc_id bigint, text string"
    want = {r["id"]: (r["n_removed"], r["kept_sha256"]) for r in substrings.judge(spark.createDataFrame(few, schema)).collect()}
    copies = spark.range(20_000).selectExpr("cast(3 as bigint) as doc_id", f"'{other}' as text")
    start = time.time()
    got = substrings.judge(spark.createDataFrame(few[:1], schema).unionByName(copies)).groupBy("id", "n_removed", "kept_sha256").count().collect()
    assert {(r["id"], r["n_removed"], r["kept_sha256"]): r["count"] for r in got} == {(1, *want[1]): 1, (3, *want[3]): 20_000}
    assert want[3][0] == 150
    assert time.time() - start < 90


@pytest.mark.parametrize("kind, ids", [("bigint", [(1 << 63) - 1, 5, None, -7]), ("string", ["b", "a", None, "abc"]), ("decimal(20,0)", [9, 2, None, -1])])
def test_ids_of_any_type_keep_their_order(spark, kind, ids):
    from decimal import Decimal

    rng = random.Random(8)
    base = _text(rng, 120)
    rows = [(Decimal(i) if kind.startswith("dec") and i is not None else i, f"x{k} " + base) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = {r["id"]: r["n_removed"] for r in substrings.judge(docs).collect()}
    first = min((i for i, _ in rows if i is not None))
    assert got == {i: 0 if i == first else 120 for i, _ in rows}
    kept = {r["doc_id"]: len(r["text"].split()) for r in substrings.deduplicate(docs.selectExpr("*", "1 as ord", "2 as _order_of_ids", "3 as h")).collect()}
    assert kept == {i: 121 if i == first else 1 for i, _ in rows}


def test_text_work_keeps_its_tasks(spark, tmp_path):
    docs = spark.range(64).selectExpr("id as doc_id", "repeat('some words of text ', 2000) as text")
    docs.repartition(16).write.parquet(f"{tmp_path}/many")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    many, one = spark.read.parquet(f"{tmp_path}/many"), spark.read.parquet(f"{tmp_path}/one")
    assert shared.spread(many).rdd.getNumPartitions() == many.rdd.getNumPartitions() > 1
    tasks = shared.spread(one).selectExpr("spark_partition_id() as p").distinct().count()
    assert tasks == spark.sparkContext.defaultParallelism


def test_splits_are_those_of_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(11)
    library, coder = Tokenizer.from_file(bpe.vocabulary_path()), bpe.Coder(bpe.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    signs = [*"ab'stremvld  \n\t.,!<|>09\xe9\xd7\xf7\xaa\xb2\xdf\x85\xa0’中\U0001f600İɀ\0\x1f", "<|endoftext|>", "'ll", " 's", "longwordlongwordlong", "  "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ["".join(chr(rng.randrange(0x260)) for _ in range(40)) for _ in range(1000)]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in coder.encode(texts)] == want
    coder.table = splits.Table(50)  # full at once: the rest is encoded each time
    assert [x.tolist() for x in coder.encode(texts)] == want
