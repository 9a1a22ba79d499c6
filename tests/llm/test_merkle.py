"""The Merkle manifest against a plain tree, and its defined results."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fanout):
    """Root and, for each node, its siblings level by level."""
    row, at, proofs = nodes, list(range(len(nodes))), [[] for _ in nodes]
    while len(row) > 1:
        for proof, k in zip(proofs, at):
            first = k - k % fanout
            proof.append(("".join(row[first:k]), "".join(row[k + 1 : first + fanout])))
        row = [sha("".join(row[k : k + fanout])) for k in range(0, len(row), fanout)]
        at = [k // fanout for k in at]
    return row[0], proofs


def plain_manifest(rows, fanout=3):
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(sources[s], key=lambda x: x[:3]), *plain_tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])], fanout)) for s in names}
    root, tops = plain_tree([trees[s][1] for s in names], fanout)
    out = []
    for s, top in zip(names, tops):
        leaves, subroot, proofs = trees[s]
        out += [(x[3][0], s, x[2], subroot, root, tuple(p for pair in proof + top for p in pair)) for x, proof in zip(leaves, proofs)]
    return out


def found(docs, **options):
    got = merkle.manifest(docs, **options).collect()
    return [(r["id"], r["source"], r["leaf"], r["subroot"], r["root"], tuple(r["proof"])) for r in got]


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row[:2]) + row[2:]


@pytest.mark.parametrize("fanout, levels", [(3, 7), (3, 1), (2, 2), (5, 2)])
def test_manifest_against_plain_trees(spark, fanout, levels):
    rng = random.Random(fanout * 10 + levels)
    rows = [(k, rng.choice(["hot", "hot", "hot", "a", "é", "", None]), rng.choice(["en", None]), rng.choice([7, None]), rng.choice(["x\ny", "", None, "ü" * 5])) for k in range(160)]
    rows += [(1000 + k, f"single{k}", "en", 1, "t") for k in range(30)] + [(None, "hot", None, None, None)] * 2 + [(None, None, "x", 1, "z")] + [(5, "hot", "en", 1, "same")] * 12
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(found(docs, fanout=fanout, levels=levels), key=key) == sorted(plain_manifest(rows, fanout), key=key)


def test_proofs_show_what_was_changed(spark):
    rows = [(k, f"s{k % 3}", "en", 3, f"line {k}\nnext" if k % 2 else "plain") for k in range(50)]
    docs = spark.createDataFrame(rows, SCHEMA)
    copy = F.when(F.col("doc_id") < 20, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    claimed = merkle.leaf_of([F.col(c) if c != "text" else copy for c in merkle.FIELDS])
    got = merkle.manifest(docs, claimed=claimed)
    got = got.withColumn("good", merkle.folded(F.col("claimed"), F.col("proof")) == F.col("root"))
    assert {r["id"] for r in got.where("not good").collect()} == {k for k in range(20) if k % 2}


def test_lone_rows_and_empty_tables(spark):
    one = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    ((_, _, leaf, subroot, root, proof),) = found(one)
    assert leaf == subroot == root == sha("1:1----") and proof == ()
    assert merkle.folded(F.lit("a"), F.array().cast("array<string>")) is not None
    assert one.select(merkle.folded(F.lit("a"), F.array().cast("array<string>")).alias("x")).first()["x"] == "a"
    assert found(one.limit(0)) == []


def test_other_columns_and_id_types_do_not_matter(spark):
    rows = [(f"id{k}", "s", "en", 1, "t" * 100_000 if k == 3 else "t") for k in range(9)]
    docs = spark.createDataFrame(rows, SCHEMA.replace("doc_id bigint", "doc_id string"))
    clashing = docs.selectExpr("*", "1 as node", "2 as _index", "3 as claimed", "4 as id", "5 as _n")
    assert sorted(found(clashing)) == sorted(found(docs)) == sorted(plain_manifest_of_strings(rows))


def plain_manifest_of_strings(rows):
    leaves = sorted((r[0], plain_leaf(r)) for r in rows)
    subroot, proofs = plain_tree([leaf for _, leaf in leaves], 3)
    return [(i, "s", leaf, subroot, subroot, tuple(p for pair in proof for p in pair)) for (i, leaf), proof in zip(leaves, proofs)]
