import random

import numpy as np
import plain
from conftest import prose

from sinew.llm.decontaminate import contamination, decontaminated
from sinew.llm.fmindex import FmIndex, suffix_order


def items(llm, corpus):
    rng = random.Random(1)
    rows = []
    for k, (_, text) in enumerate(corpus[::4]):
        words = plain.plain_words(text)
        rows.append((k, "-".join(w.capitalize() if w.isascii() else w for w in words[5:30])))
    rows += [(100, prose(rng, 25)), (101, None), (102, " .,"), (103, "w5"), (104, "w1 w2"), (None, rows[2][1]), (2, rows[4][1]), (105, rows[6][1]), (106, "w7é " * 12)]
    return llm.createDataFrame(rows, "item_id long, text string"), rows


def found(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in df.collect()}


def test_contamination(llm, docs, corpus):
    benchmark, rows = items(llm, corpus)
    expected = plain.contamination(corpus, [r for r in rows if r[0] is not None])
    for options in ({}, {"item_bytes": 700}):
        got = contamination(docs, benchmark, **options)
        assert found(got) == expected
        assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got.collect())
    assert sum(v[1] > 0 for v in expected.values()) > 15


def test_cut_texts_have_no_window_left(llm, docs, corpus):
    benchmark, rows = items(llm, corpus)
    keyed = [r for r in rows if r[0] is not None and len(plain.plain_words(r[1])) >= 10]
    benchmark = llm.createDataFrame(keyed, "item_id long, text string")
    cut = decontaminated(docs, benchmark)
    assert cut.columns == docs.columns
    after = {r["doc_id"]: r for r in cut.collect()}
    before = plain.contamination(corpus, keyed)
    left = plain.contamination([(d, r["text"]) for d, r in after.items()], keyed)
    for d, text in corpus:
        if before[d][1]:
            assert left[d][1] == 0 and left[d][0] == before[d][0] - before[d][1]
            assert after[d]["n_chars"] == len(after[d]["text"])
        else:
            assert after[d]["text"] == text


def test_empty_tables(llm, docs, empty, corpus):
    benchmark, _ = items(llm, corpus)
    assert contamination(empty, benchmark).count() == 0
    clean = contamination(docs, benchmark.limit(0)).collect()
    assert len(clean) == len(corpus) and not any(r["contaminated"] for r in clean)


def test_suffix_order_and_search():
    rng = np.random.default_rng(0)
    for sigma, n in ((2, 60), (3, 200), (40, 500)):
        block = rng.integers(0, sigma, n).astype(np.int32)
        text = np.concatenate([block, [0], block[: n // 2], [0], np.ones(30, np.int32), [0], block, [0]]).astype(np.int32)
        extended = [(int(s), i if s == 0 else -1) for i, s in enumerate(text)]
        assert suffix_order(text, max(1, (sigma - 1).bit_length())).tolist() == sorted(range(len(text)), key=lambda i: extended[i:])
        index = FmIndex(text, sigma)
        for size in (1, 2, 5, 12):
            windows = np.lib.stride_tricks.sliding_window_view(text, size)
            phrases = np.unique(windows[(windows > 0).all(axis=1)], axis=0)
            absent = rng.integers(1, sigma, (20, size)).astype(np.int32)
            for phrase, lo, hi in zip(*(np.concatenate(x) for x in ([phrases, absent],)), *index.search(np.concatenate([phrases, absent])), strict=True):
                places = sorted(index.locate(np.arange(lo, hi)).tolist())
                assert places == np.flatnonzero((windows == phrase).all(axis=1)).tolist()
