"""Licence scans against a scorer in plain Python, on wordings and families that training has not seen, and on edge cases."""

import re
from collections import Counter

import numpy as np

from cadenza.llm import licenses
from cadenza.llm.license_texts import MARKS, NAMES, OTHER_NAMES, OTHERS, PHRASES, TEMPLATES

#: Phrases, texts and other uses of the words that training does not have.
UNSEEN_PHRASES = (
    "You may use all of it under the {}.", "Everything here falls under the {}", "The data set is covered by the {}.",
    "Code is {}, docs are separate", "We chose the {} for this package"
)
UNSEEN_OTHERS = ("bridge over the river", "terms of the treaty", "rule of the king", "tree")
WRAPPED_MIT = (
    "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction,\n"
    "including without limitation the rights to use, copy, modify,\nmerge, publish, distribute, sublicense, and/or sell copies"
)
WRAPPED_BSD = (
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"
    "1. Redistributions of source code must retain the above copyright\n   notice, this list of conditions and the following disclaimer."
)
WRAPPED_LGPL = (
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\n"
    "version 2.1 of the License, or (at your option) any later version."
)


def score(text, m=None, threshold=licenses.THRESHOLD, agreement=licenses.AGREEMENT):
    """(family, probability, agreement, whole), by sums over sets."""
    m = m or licenses.train()
    words = licenses._plain(text)
    grams = licenses._grams_of(words)
    z = np.array(m.bias) + sum((np.array(m.weights[g]) for g in grams if g in m.weights), np.zeros(len(m.families)))
    e = np.exp((z - z.max()) / m.temperature)
    p = e / e.sum()
    family = m.families[int(p.argmax())]
    shares = [
        (len(grams & set(t)) / max(1, min(len(t), len(grams))), len(grams & set(t)) >= licenses.WHOLE * len(t)) for t in m.templates.get(family, [])
    ]
    share, whole = max(shares, default=(0.0, False))
    known = family != licenses.UNKNOWN and p.max() >= threshold and share >= agreement
    return family if known else licenses.UNKNOWN, float(p.max()), share, whole


def found_in(paragraph):
    lines = [s for s in map(score, paragraph.split("\n")) if s[0] != licenses.UNKNOWN]
    whole = [s for s in [score(paragraph)] if s[0] != licenses.UNKNOWN and "\n" in paragraph]
    return [s for s in lines if s[3]] or whole or lines


def brute_scan(text):
    paragraphs = [p for p in re.split(r"\n(?:[^\S\n]*\n)+", text or "") if p.strip()]
    found = [f for f in map(found_in, paragraphs) if f]
    every = [s for f in found for s in f]
    best = max(((s[1], s[0]) for s in every), default=(0.0, licenses.UNKNOWN))
    return len(paragraphs), len(found), ",".join(sorted({s[0] for s in every})), best[1], round(best[0], 6)


def test_scan_equals_the_plain_scorer_on_texts_of_all_kinds(spark, sf_dir):
    rng = np.random.default_rng(4)
    notices = [
        *OTHERS, *[t for ts in TEMPLATES.values() for t in ts],
        *[p.format(n) for ns in NAMES.values() for n in ns for p in (*PHRASES[::4], *UNSEEN_PHRASES[::2])], WRAPPED_MIT, WRAPPED_BSD, WRAPPED_LGPL
    ]
    words = [t.split() for t in notices]
    notices += [" ".join(w[k : k + 5]) for w in words for k in range(0, len(w), 9)]
    made = [sep.join(rng.choice(notices, int(rng.integers(1, 5)))) for sep in ("\n", "\n\n", "\n \t\n\n", " ") for _ in range(120)] + notices
    made += [None, "", "\n\n", " \n lone line", "\n\nMIT License\n\n\n"]
    docs = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(made)], "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.scan(docs.repartition(8)).collect():
        want = brute_scan(texts[r.id])
        got = (r.n_paragraphs, r.n_licensed, r.families, r.family, r.probability)
        assert got[:3] == want[:3] and abs(got[4] - want[4]) < 1e-5 and (got[3] == want[3] or abs(got[4] - 1) < 1e-5), (texts[r.id], got, want)


def test_recall_on_unseen_phrases_and_no_false_finding():
    right = [score(p.format(n))[0] == f for f, ns in NAMES.items() for n in ns for p in UNSEEN_PHRASES]
    assert np.mean(right) >= 0.95
    wrong = [score(p.format(n))[0] != licenses.UNKNOWN for n in (*OTHER_NAMES, *UNSEEN_OTHERS) for p in UNSEEN_PHRASES]
    assert np.mean(wrong) <= 0.02


def test_recall_on_phrases_of_the_list_when_they_are_left_out():
    out = PHRASES[::3]
    m = licenses.train(without=out)
    results = [(f, score(p.format(n), m)[0]) for f, ns in NAMES.items() for n in ns for p in out]
    found = [(f, g) for f, g in results if g != licenses.UNKNOWN]
    assert len(found) >= 0.9 * len(results) and sum(f == g for f, g in found) >= 0.97 * len(found)


def test_a_family_that_training_has_not_seen_is_mostly_unknown():
    """Held-out families: their own names are strange to the model. Texts close to another family may take its name."""
    for family in ("Zlib", "EUPL", "MPL"):
        m = licenses.train(without=(family,))
        got = Counter(score(p.format(n), m)[0] for n in NAMES[family] for p in PHRASES)
        assert got[family] == 0 and got[licenses.UNKNOWN] >= 0.6 * got.total(), (family, got)


def test_wrapped_notices_are_found_whole_and_notices_amid_prose_are_found(spark):
    prose = "The harbour was quiet and the boats lay still in the morning light."
    texts = [
        WRAPPED_MIT, WRAPPED_BSD, WRAPPED_LGPL, f"{prose}\nReleased under the MIT License.\n{prose}",
        f"{prose}\nReleased under the MIT License.\nLicensed under CC BY 4.0.", f"{prose}\n\n{prose}\n{WRAPPED_BSD}"
    ]
    texts += [(prose + "\n") * 4000 + "\nLicensed under the ISC license."]
    docs = spark.createDataFrame([(i, t, "own", 1) for i, t in enumerate(texts)], "doc_id long, text string, family string, n_licensed int")
    got = {r.id: (r.families, r.n_licensed) for r in licenses.scan(docs).collect()}
    assert got == {0: ("MIT", 1), 1: ("BSD", 1), 2: ("LGPL", 1), 3: ("MIT", 1), 4: ("CC-BY,MIT", 1), 5: ("BSD", 1), 6: ("ISC", 1)}
    rows = {(r.id, r.paragraph, r.family) for r in licenses.paragraphs(docs).collect()}
    assert rows == {(0, 0, "MIT"), (1, 0, "BSD"), (2, 0, "LGPL"), (3, 0, "MIT"), (4, 0, "MIT"), (4, 0, "CC-BY"), (5, 1, "BSD"), (6, 1, "ISC")}


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "MIT License"), (1, "MIT License"), (None, None), (2, "")], "doc_id long, text string")
    got = sorted(((r.id, r.n_paragraphs, r.n_licensed, r.family) for r in licenses.scan(docs).collect()), key=str)
    assert got == [(1, 1, 1, "MIT"), (1, 1, 1, "MIT"), (2, 0, 0, "unknown"), (None, 0, 0, "unknown")]
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.paragraphs(docs.limit(0)).count() == 0


def test_words_that_are_set_aside_cannot_lift_a_family(spark):
    """The filter is derived from the weights: paragraphs without a telling word stay below the threshold, whatever they hold."""
    m, telling = licenses.train(), set(licenses.telling_words())
    assert telling <= MARKS
    quiet = [g for g in m.weights if telling.isdisjoint(g.split())]
    lead = np.maximum(
        np.array([m.weights[g] for g in quiet])[:, :-1] - np.array([m.weights[g] for g in quiet])[:, -1:], 0
    ).sum(axis=0) if quiet else 0
    most = lead + np.array(m.bias[:-1]) - m.bias[-1]
    assert (most < m.temperature * np.log(licenses.THRESHOLD / (1 - licenses.THRESHOLD))).all()


def test_short_forms_bodies_and_other_uses():
    found = {
        "You may use this under GPLv3.": "GPL", "GPLv2+": "GPL", "MIT licensed.": "MIT", "(c) 2019, released under Apache 2": "Apache-2.0",
        "Available under the Open Font License 1.1.": "OFL", "Code: LGPLv3": "LGPL", "Published under AGPLv3 by the authors": "AGPL",
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate "
        "copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code": "GPL",
    }
    assert {t: score(t)[0] for t in found} == found
    for text in ("She bought a zlib compressed archive.", "The front seats are reserved.", "The bag was compressed and the rights were sold.", "A verbatim report was read in court."):
        assert score(text)[0] == licenses.UNKNOWN, text
    assert score("Dual licensed MIT/Apache-2.0")[0] in ("MIT", "Apache-2.0")
