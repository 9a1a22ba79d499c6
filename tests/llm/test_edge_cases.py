"""Nulls, repeated rows, very long texts, clashing columns and string ids, operator by operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cadenza.llm import chat, quality, simhash, substrings, warc

LONG = " ".join(f"w{i}" for i in range(120_000))


def test_chat_records_with_more_fields_and_empty_lists(spark):
    raw = [
        (1, '{"messages": [], "id": 7}'), (2, '{"messages": []}'), (3, '{"prompt": "q", "completion": "a", "meta": {"x": [1]}}'),
        (4, '{"instruction": "i", "output": "o", "input": "n", "source": "s"}'), (5, '{"messages": [{"other": 1}]}'), (6, '{"messages": "text"}'),
        (7, '{"conversations": [{"from": "human", "value": "q", "weight": 1}], "id": "x"}'),
    ]
    found = {r.id: r for r in chat.from_json(spark.createDataFrame(raw, "id long, raw string"), "id", "raw").collect()}
    assert {i: r.layout for i, r in found.items()} == {
        1: "messages", 2: "messages", 3: "prompt_completion", 4: "instruction_input_output", 5: None, 6: None, 7: "share"
    }
    assert found[1].turns == [] and [t.text for t in found[4].turns] == ["i\n\nn", "o"] and [tuple(t) for t in found[7].turns] == [("user", "q")]


def test_chat_masks_of_a_long_conversation(spark):
    rows = [(1, k, ("user", "assistant", "system")[k % 3], f"é<|{'x' * (k % 7)}") for k in range(3001)] + [(2, 0, "user", "only")]
    out = chat.render(chat.from_table(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id"))
    found = {r.id: r for r in out.withColumn("said", chat.loss_text(F.col("formatted"), F.col("loss"))).collect()}
    assert found[1].said == "".join(t for c, _, r, t in rows if c == 1 and r == "assistant") and found[2].said == "" and found[2].loss == []
    assert [found[1].formatted[s.begin : s.begin + s.length] for s in found[1].loss[:3]] == ["é<\\|x", "é<\\|xxxx", "é<\\|"]


def test_simhash_of_null_ids_and_repeated_rows(spark):
    rows = [
        (None, "one two three four"), (None, "one two three four"), (5, "one two three four"), (None, "quite other words here and there"), (9, LONG),
        (9, LONG)
    ]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.id), str(r.component)) for r in found) == [
        ("5", "5"), ("9", "9"), ("9", "9"), ("None", "5"), ("None", "5"), ("None", "None")
    ]


def test_quality_of_null_ids_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = [(None, LONG, 1, False), (None, LONG, 1, False), (2, None, 2, True), (3, "short", 3, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean")
    found = sorted(((str(r.id), r.n_words, r.kept) for r in quality.judge(docs).collect()), key=str)
    assert found == [("2", 0, False), ("3", 1, False), ("None", 120_000, True), ("None", 120_000, True)]
    kept = quality.keep(docs)
    assert kept.schema == docs.schema and [tuple(r)[2:] for r in kept.collect()] == [(1, False)] * 2
    assert quality.keep(docs.limit(0)).count() == 0


def test_quality_rejects_junk_and_keeps_clean_documents(spark):
    """Against the labels: separators that stand as words of their own, and no clean document for its symbols."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    judged = quality.judge(
        spark.read.parquet(f"{sf}/documents.parquet")
    ).where("n_words >= 50").withColumnRenamed("id", "doc_id").join(labels, "doc_id")
    share = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.9 and share[0] <= 0.35, share


def test_substrings_of_a_long_text_and_repeated_rows(spark):
    words = LONG.split()
    rows = [
        (1, LONG), (2, " ".join(words[50_000:50_080]) + " own words"), (2, "another text with that id"), (3, " ".join(words[10:59])),
        (None, " ".join(words[:60]))
    ]
    docs = spark.createDataFrame([(i, t, "own") for i, t in rows], "doc_id long, text string, spans string")
    found = sorted(((str(r.id), r.n_words, r.n_removed) for r in substrings.judge(docs).collect()))
    assert found == [("1", 120_000, 0), ("2", 5, 0), ("2", 82, 80), ("3", 49, 0), ("None", 60, 60)]
    left = substrings.deduplicate(docs)
    assert left.columns == docs.columns and {r.text for r in left.where("doc_id = 2").collect()} == {"own words", "another text with that id"}


def test_warc_of_repeated_rows_and_long_payloads(spark):
    rows = [(4, "u", "p" * 150), (4, "u", "p" * 150), (6, "v", "p" * 150), (7, "w", LONG), (8, None, LONG)]
    found = sorted(
        (r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(
            spark.createDataFrame(rows, "page_id long, url string, html string")
        ).collect()
    )
    digest, long = (hashlib.sha256(x.encode()).hexdigest() for x in ("p" * 150, LONG))
    assert [x[:3] for x in found] == [(4, 150, digest)] * 2 + [(6, 150, digest), (7, len(LONG), long), (8, len(LONG), long)]
    assert [x[3:] for x in found][2:] == [("revisit", 4), ("response", None), ("revisit", 7)]


@pytest.mark.parametrize("name", ["url", "component", "fp"])
def test_near_duplicates_keep_columns_of_any_name(spark, name):
    docs = spark.createDataFrame([(1, "same words in here", "a"), (2, "same words in here", "b")], f"doc_id long, text string, `{name}` string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "same words in here", "a")]
