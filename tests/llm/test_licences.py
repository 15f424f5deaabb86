import re

import plain

from sinew.llm import licences as L

TEXTS = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0. All rights reserved", "mit mit license license MIT-LICENSE mit\nlicense",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: GPL-2.0-only", None, "", "no such thing",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this", "general public licence, generalpublic license, the general public license",
    "Neither the name of A B C D E F G H I J K L M N O P Q R S T U V nor the names of its contributors may be used to endorse", "neither the name of " + "a " * 30 + "nor the names of its contributors may be used",
    "neither the name of " + "a " * 31 + "nor the names of its contributors may be used", "lesser general public license 2.1 or later; BSD 3-Clause; Copyright (c) 2020 X", "é" * 40 + " MIT LICENSE ü apache license", "Mozilla Public License 2.0 " * 40,
]


def brute(text):
    """Detections by trying every rule at every word, and suppression by comparing all of them."""
    words = plain.plain_words(text)
    found = []
    for i in range(len(words)):
        stretch = " ".join(words[i:])
        for r in L.rules():
            if m := re.match(r["pattern"], stretch):
                found.append((i, i + len(m.group().split(" ")), r["priority"], r["label"], r["id"]))
    kept = []
    for a in found:
        better = [b for b in found if b is not a and b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and ((b[0], b[1]) != (a[0], a[1]) or b[2] > a[2] or b[4] < a[4])]
        if not better:
            kept.append(a[:4])
    return sorted(kept)


def test_scan(llm):
    df = llm.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").selectExpr("*", "1 AS labels", "2 AS _words")
    for r in L.licences(df).collect():
        text = TEXTS[r["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain.licence_base(text)
        expected = brute(text)
        assert sorted(tuple(d) for d in r["detections"]) == expected
        assert r["labels"] == ",".join(sorted({d[3] for d in expected} | set(filter(None, r["base_labels"].split(",")))))
        assert r["score"] == max([L.CONFIDENCE[d[2]] for d in expected] + ([0.6] if r["n_base"] else [0.0]))


APART = [
    "Photos: CC-BY-SA 4.0", "EPL-2.0", "GFDL 1.3", "CeCILL-2.1", "ASL 2.0", "Apache (2.0)", "released into the public\ndomain", "Creative\nCommons\tZero", "MIT-no-attribution",
    "neither the name of X nor the names of its contributors may be used", "all\nrights\nreserved", "European-Union-Public-Licence", "Unicode: terms\nof use", "AGPLv3", "all advertising\nmaterials mentioning features or use of this software", "nothing of the kind",
]


def test_gate_lets_no_rule_out(llm):
    df = llm.createDataFrame(list(enumerate(APART)), "doc_id int, text string")
    for r in L.licences(df).collect():
        assert sorted(tuple(d) for d in r["detections"]) == brute(APART[r["doc_id"]]), APART[r["doc_id"]]
    assert all(brute(t) for t in APART[:-1])
    assert all(re.fullmatch("[a-z0-9]+", part) for part in L.gate())
    for pattern in [*L.NAMES.values(), *(p for _, p in L.SENTENCES), *L.BASE]:
        for alternative in L._alternatives(pattern):
            assert any(part in fragment for part in L.gate() for fragment in L._fragments(alternative)), alternative


def test_stretch_is_as_wide_as_the_widest_rule():
    assert L._most_words(r"^(?:a b(?: c d| e)?|f)(?= |$)") == 4
    assert L._most_words(r"^(?:a .{1,60}b)(?= |$)") == 32
    assert L.stretch() >= 43
    assert "bsd-3-clause" in {d[3] for d in brute(TEXTS[11])} & {d[3] for d in brute(TEXTS[12])} and not brute(TEXTS[13])


def test_rules_are_gated_by_their_leads():
    table = L.rules()
    assert len(table) > 200
    for r in table:
        assert all(re.fullmatch(r"[a-z0-9]+", lead) for lead in r["leads"]), r


def test_corpus_and_empty(docs, corpus, empty):
    found = {r["doc_id"]: r for r in L.licences(docs).collect()}
    for d, text in corpus:
        assert (found[d]["n_words"], found[d]["n_base"]) == plain.licence_base(text)[:2]
    assert L.licences(empty).count() == 0
