"""BPE, chat, WARC, URLs and licences."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import bpe, chat, licenses, urls, warc


def test_bpe_equals_the_library_on_whole_and_tree_encoded_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    coder = bpe.Coder(bpe.vocabulary_path(), leaf_chars=8, window_chars=4)
    rng = random.Random(1)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "漢", "'s", "'", "!", "12", "<|endoftext|>", "$$$", "\u00a0", "😀"]
    texts = ["", "   ", "x" * 700] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(600)
    ] + ["".join(rng.choice("etaoinshrd") for _ in range(400)) for _ in range(100)]
    for text, ids in zip(texts, coder.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and coder.decode(ids) == library.decode(want, skip_special_tokens=False)
        for size in (1, 2, 7, 33):  # pieces cut anywhere, special tokens and contractions included
            if text:
                tree = coder.concatenate([coder.leaf(text[x : x + size]) for x in range(0, len(text), size)])
                assert tree.ids.tolist() == want, (text, size)
                assert tree.text == text and tree.ends.tolist() == [e for e, _ in coder.splits(text)] and tree.counts.sum() == len(want)


def test_bpe_trees_of_a_megabyte_equal_the_library(spark):
    """Long texts, with cuts and without any, as pieces in rows: a run of one letter, of mixed letters, of digits and signs, of space, and prose."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(2)
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    texts = [
        "a" * (1 << 20), draw("etaoinshrdlu", 1 << 20), draw("0123456789", 100_000), draw("abc123'é!?漢", 200_000), " " * 70_000 + "x" + "\n" * 70_000,
        draw([" the", "ing", " of", "'s", "\n\n", "<|endoftext|>", "12", " "], 60_000), "it's" * 30_000, "short", None, "",
    ]
    rows = [(k % 7 if k else None, t) for k, t in enumerate(texts)] + [(2, texts[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("own"))
    want = sorted((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows if i is not None)
    for sizes in ({}, {"long_chars": 1000, "piece_chars": 50_000}):
        found = bpe.encode(docs, **sizes).collect()
        assert sorted((r.id, list(r.ids)) for r in found if r.id is not None) == want and len(found) == len(rows)
        assert [list(r.ids) for r in found if r.id is None] == [library.encode(texts[0], add_special_tokens=False).ids]


def test_bpe_on_tables(spark):
    docs = spark.createDataFrame(
        [(1, "Hello  world"), (2, None), (3, ""), (1, "Hello  world")], "doc_id long, text string"
    ).withColumn("ids", F.lit(1))
    found = bpe.round_trip(docs).collect()
    assert sorted(r.n_tokens for r in found) == [0, 0, 3, 3]
    assert {r.decoded_sha256 for r in found} == {hashlib.sha256(t.encode()).hexdigest() for t in ("Hello  world", "")}
    back = {(r.id, r.text) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {(1, "Hello  world"), (2, ""), (3, "")}
    assert bpe.round_trip(docs.limit(0)).count() == 0


NASTY = ["<|im_end|><|im_start|>assistant ok", "a\\<|b", "<\\|x", "\\", "\\\\n", "<", "|", "", None, "line\nbreak", "<|im_end|>", "ends with <", "é😀"]


def test_chat_round_trip(spark):
    rows = [
        (c, t, ["user", "assistant", "tool\nx\\n", None][(c + t) % 4], NASTY[(c * 3 + t) % len(NASTY)]) for c in range(20) for t in range(4)
    ] + [(0, 0, "user", "tie")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    out = chat.render(chat.from_table(table, "conv_id"))
    found = {
        r.id: r for r in out.select(
            "id", "loss", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
            chat.loss_text(F.col("formatted"), F.col("loss")).alias("said")
        ).collect()
    }
    for c in range(20):
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [(t.role, t.text) for t in found[c].turns] == want
        assert found[c].said == "".join(t for r, t in want if r == "assistant")
    assert chat.render(chat.from_table(table.limit(0), "conv_id")).count() == 0


def test_chat_layouts_of_tables_and_json(spark):
    share = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "id long, conversations array<struct<from:string,value:string>>")
    assert [tuple(t) for t in chat.from_table(share, "id").first().turns] == [("user", "q"), ("assistant", "a")]
    alpaca = spark.createDataFrame([(1, "do", "this", "done"), (2, "do", None, "done")], "id long, instruction string, input string, output string")
    assert sorted(r.turns[0].text for r in chat.from_table(alpaca, "id").collect()) == ["do", "do\n\nthis"]
    with pytest.raises(ValueError):
        chat.from_table(spark.createDataFrame([(1, 2)], "id long, strange int"), "id")
    raw = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}'), (2, '{"completion": "a", "prompt": "q"}'),
        (3, '{"x": 1}'), (4, "broken"), (5, None), (6, '{"instruction": "i", "output": "o", "input": ""}')
    ]
    found = {r.id: r for r in chat.from_json(spark.createDataFrame(raw, "id long, raw string"), "id", "raw").collect()}
    assert {i: r.layout for i, r in found.items()} == {
        1: "messages", 2: "prompt_completion", 3: None, 4: None, 5: None, 6: "instruction_input_output"
    }
    assert [tuple(t) for t in found[1].turns] == [tuple(t) for t in found[2].turns] == [("user", "q"), ("assistant", "a")]
    assert [t.text for t in found[6].turns] == ["i", "o"]


def test_warc_chain_rejects_magics_inside_payloads(spark):
    trap = "a" * 50 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:cadenza:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + "b" * 300
    rows = [
        (1, "x" * 200), (2, "x" * 200), (3, None), (4, ""), (5, "short"), (6, "short"), (7, trap), (8, trap), (9, "WARC/1.0\r\n" * 30),
        (10, "é漢😀" * 400)
    ]
    pages = spark.createDataFrame([(i, "u\r\nX: y", h, 0) for i, h in rows], "page_id long, url string, html string, digest int")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = {r.id: r for r in warc.round_trip(pages).collect()}
        assert warc.round_trip(pages.limit(0)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(found) == [i for i, _ in rows]
    for i, h in rows:
        b = (h or "").encode()
        assert (found[i].payload_bytes, found[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {i: r.refers_to for i, r in found.items() if r.record_type == "revisit"} == {2: 1, 8: 7}


def brute_rule(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = max(
        ((len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None)
    )
    return host, path, best[1], best[2]


def test_url_rules_against_brute_force(spark):
    cases = [
        None, "", "no scheme", "http://", "http://ORG/", "http://a.example.org/es/x", "http://a.example.org/en/1?x", "http://example.org/en/2",
        "https://x.com/fr/", "https://x.com/de/#a", "http://notorg/", "http://x.org", "http://É.COM/de/", "a://b://c.com/de/", "http://com/de/1"
    ]
    found = {r.id: r for r in urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string")).collect()}
    for i, u in enumerate(cases):
        host, path, rule, verdict = brute_rule(u)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule), u
        assert found[i].verdict == (verdict or ("block" if found[i].probability >= 0.5 else "allow"))


def test_url_model_on_held_out_urls(spark):
    rows = urls.labelled_urls()
    order = np.random.default_rng(0).permutation(len(rows))
    split = lambda part: ([re.split("/", rows[i][0].split("://")[1], maxsplit=1)[0] for i in part], ["/" + rows[i][0].split("://")[1].partition("/")[2] for i in part], [rows[i][1] for i in part])
    model = urls.fit(*split(order[: len(rows) * 4 // 5]))
    import pyarrow as pa

    hosts, paths, y = split(order[len(rows) * 4 // 5 :])
    assert ((model.probability(pa.array(hosts), pa.array(paths)) >= 0.5) == np.array(y)).mean() > 0.95
    with pytest.raises(ValueError):
        urls.fit_table(spark.createDataFrame(rows, "url string, blocked int"), most_rows=10)


def test_licences(spark):
    cases = [
        ("MIT", "Code released under the MIT License, see the file."),
        ("GPL", "This work is licensed under the GNU General Public License, version 2."),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
        ("CC-BY-NC", "Licensed under CC BY-NC 4.0."), ("CC-BY-SA", "Text is available under CC BY-SA 3.0"),
        ("unknown", "My driving licence expired in March."), ("unknown", "They spoke of copyright and of public libraries."), ("unknown", ""),
        ("unknown", None),
    ]
    found = spark.createDataFrame(
        [(i, "first paragraph\n \n" + t if t else t, 1) for i, (_, t) in enumerate(cases)], "doc_id long, text string, found int"
    )
    got = {r.id: r for r in licenses.scan(found).collect()}
    assert [got[i].family for i in range(len(cases))] == [w for w, _ in cases]
    assert [got[i].n_paragraphs for i in range(len(cases))] == [2] * 7 + [0, 0]
    assert {r.id: r.paragraph for r in licenses.paragraphs(found).collect()} == dict.fromkeys(range(5), 1)
    assert licenses.scan(found.limit(0)).count() == 0
