from collections import defaultdict

import plain
import pytest

from sinew.llm.mixing import mixed, resampled


def expected_targets(rows, weights=(1, 2, 3), cap=3):
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(plain.spaced(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, open_, target = sum(size.values()), set(size), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * size[s]]
        if not over:
            return size, {**target, **share}
        for s in over:
            target[s] = cap * size[s]
            open_.discard(s)


def table(llm, corpus):
    rows = [(d, t, ["b", "a", None, "ä", "z", "Z"][d % 6]) for d, t in corpus]
    rows += [(2000 + i, "only few words", "rare") for i in range(3)] + [(3000, None, "void"), (3001, "", "void")]
    return rows, llm.createDataFrame(rows, "doc_id long, text string, source string")


def test_mix(llm, corpus):
    rows, df = table(llm, corpus)
    size, target = expected_targets(rows)
    found = mixed(df.selectExpr("*", "1 AS taken", "2 AS rate")).collect()
    source = {d: s for d, _, s in rows}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert len(found) == len(rows)
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1
    again = mixed(df.repartition(5)).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in found}
    many = {r["doc_id"]: r["copies"] for r in found if r["size"]}
    got = defaultdict(int)
    for r in resampled(df).collect():
        got[r["doc_id"]] += 1
    words = defaultdict(int)
    text = {d: t for d, t, _ in rows}
    for d, k in got.items():
        words[source[d]] += k * len(plain.spaced(text[d]))
    for s in size:
        assert abs(words[s] - target[s]) <= largest[s] / 2 + 1
    assert sum(many.values()) > 0


def test_repeated_rows_and_nulls(llm):
    rows = [(1, "a b c", "x")] * 4 + [(None, None, None), (None, "one two", None), (2, "d " * 50, "y")]
    df = llm.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixed(df).collect()
    assert len(found) == 7 and sum(r["size"] for r in found) == 64
    assert resampled(df.selectExpr("*", "7 AS times", "8 AS rows")).columns == ["doc_id", "text", "source", "times", "rows"]


def test_empty(empty):
    assert mixed(empty).count() == 0
    assert resampled(empty).count() == 0
