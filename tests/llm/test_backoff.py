from collections import Counter
from math import log

import plain
import pytest

from sinew.llm import backoff


def expected(rows, alpha=0.4, least=2):
    words = [plain.plain_words(t) for _, t in rows]
    one, two = Counter(w for t in words for w in t), Counter(p for t in words for p in zip(t, t[1:], strict=False))
    total, out = sum(one.values()), []
    for (d, _), t in zip(rows, words, strict=True):
        value, seen = 0.0, 0
        for i, w in enumerate(t):
            pair = (t[i - 1], w)
            if i and two[pair] >= least:
                value += log(two[pair] / one[t[i - 1]])
                seen += 1
            else:
                value += log(one[w] / total) + (log(alpha) if i else 0)
        out.append((d, len(t), seen, value / len(t) if t else None))
    return out


@pytest.mark.parametrize("block_bytes,parts", [(4 << 20, 3), (700, 5)])
def test_scores(docs, corpus, block_bytes, parts):
    found = {r["doc_id"]: tuple(r)[1:] for r in backoff.scores(docs, block_bytes=block_bytes, parts=parts).collect()}
    for d, n, seen, value in expected(corpus):
        assert found[d][:2] == (n, seen)
        assert found[d][2] == (None if value is None else pytest.approx(value))
    assert len(found) == len(corpus)


def test_repeated_rows_null_keys_and_empty(llm, empty):
    rows = [(1, "a b"), (1, "a b"), (None, "a c"), (2, None)]
    found = backoff.scores(llm.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS score", "0 AS block")).collect()
    assert sorted((r[0] or -1, r[1], r[2]) for r in found) == [(-1, 2, 0), (1, 2, 1), (1, 2, 1), (2, 0, 0)]
    assert backoff.scores(empty).count() == 0
