from __future__ import annotations

import hashlib

import public_tokenizers
import pytest

from sinew.llm.wordtable import decoded, encoded, round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACES = [" ", "  ", "\n", "\n\n", "\t ", "\r\n", "\u00a0", "\u3000", "\x85", "   \n x", " \u2028"]
ENDS = ["word", "9", "9a", "'ll", "don't 's", "é", "Ωβ", "日本", "!?", "_", "🙂", "<|endoftext|>", ""]
ODD = [a + s + b for s in SPACES for a in ENDS for b in ENDS]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def plainly(library, rows):
    out = []
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((key, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_the_library(docs, corpus, library):
    found = round_trip(docs, PATH)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plainly(library, corpus)


def test_small_blocks_and_buckets(llm, library):
    """Words of many blocks meet in few buckets and the other way round; repeated rows, null keys, clashing names."""
    rows = [(k % 50 if k % 7 else None, t) for k, t in enumerate([*ODD, *ODD[:40], None, "", "a" * 3000])]
    table = llm.createDataFrame([(k, t, 1, "x", 2) for k, t in rows], "doc_id long, text string, block int, Ids string, bucket int").repartition(3)
    for size, parts in ((64, 2), (700, 40)):
        found = encoded(table.sortWithinPartitions("text"), PATH, size=size, parts=parts)
        want = sorted(((k, library.encode(t or "", add_special_tokens=False).ids) for k, t in rows), key=str)
        assert sorted(((r[0], list(r[1])) for r in found.collect()), key=str) == want


def test_long_texts_and_words(llm, library):
    rows = [(1, "y" * 200_000), (2, "some words, again " * 90_000), (3, "tail"), (4, "ab " * 10 + "z" * 70_000)]
    table = llm.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, round_trip(table, PATH).collect())) == plainly(library, rows)


def test_no_rows(empty):
    assert round_trip(empty, PATH).collect() == []


def test_decoding_of_any_ids(llm, library):
    """Ids that cut characters apart, unknown ids, none, and null."""
    ids = library.encode("Ünïcode 日本 🙂 <|endoftext|>", add_special_tokens=False).ids
    rows = [(1, ids), (2, ids[1::2]), (3, ids[::-1]), (4, [60000, 5]), (5, []), (6, None)]
    table = llm.createDataFrame(rows, "doc_id long, ids array<int>")
    found = {r["doc_id"]: r["text"] for r in decoded(table, PATH).collect()}
    assert found == {k: None if i is None else library.decode(i, skip_special_tokens=False) for k, i in rows}
