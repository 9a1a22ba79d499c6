"""Empty tables, clashing columns and very long rows of the chat and archive operators."""

import hashlib

from cadenza.llm import chat, simhash, warc


def test_chat_of_no_conversations(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.render(chat.from_table(turns, "conv_id")).count() == 0


def test_archives_of_nothing_and_of_odd_pages(spark):
    schema = "page_id long, html string, type string, digest string, path string"
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    long = "WARC/1.0\r\n" * 30_000
    rows = [(1, "x" * 100, "a", "b", "c"), (2, "x" * 100, None, None, None), (3, None, "t", "d", "p"), (4, "", "t", "d", "p"), (5, long, "t", "d", "p"), (6, long, "t", "d", "p")]
    got = {r["id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, schema)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {1: ("x" * 100, None), 2: ("x" * 100, 1), 3: ("", None), 4: ("", None), 5: (long, None), 6: (long, 5)}
    assert got == {k: (len(t.encode()), digest(t), "revisit" if of else "response", of) for k, (t, of) in want.items()}


def test_very_long_texts_as_a_table(spark):
    docs = spark.range(6).selectExpr("id as doc_id", "repeat(concat('word', cast(id div 2 as string), ' '), 300000) as text")
    rows = {r["id"]: (r["fp"], r["component"]) for r in simhash.near_duplicates(docs).collect()}
    assert len(rows) == 6 and all(rows[k] == rows[k + 1] and rows[k][1] <= k for k in range(0, 6, 2))
