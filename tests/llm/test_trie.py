from __future__ import annotations

import random

import plain
import pytest
from pyspark.sql import functions as F

from sinew.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, d int, C string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(spark, rows):
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA)
    found = trie.prefix_trie(*trie.rebuilt(table))
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=str)


def talk(seed: int, conversations: int, longest: int, words: int):
    """Few different turns, so that paths meet and part at all depths; families with and without a base."""
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-60, 400), conversations):
        for turn in range(rng.randrange(1, longest + 1)):
            text = rng.choice([f"a b{rng.randrange(words)}", "a b0", "", None, "x y z"])
            rows.append((conv, None if turn == 0 and rng.random() < 0.2 else turn, rng.choice(["user", "user", "assistant", None]), text))
    return rows + [(None, 1, "user", "no conversation")]


@pytest.mark.parametrize(("seed", "longest", "words"), [(1, 6, 1), (2, 40, 2)])
def test_equals_plain_trie(llm, seed, longest, words):
    rows = talk(seed, 60, longest, words)
    assert nodes(llm, rows) == plain.trie(rows)


def test_copies_prefixes_and_combs(llm):
    """Exact copies, conversations that start others, one long path with a branch at every depth; tied and repeated turns."""
    path = [(t, "user", f"step {t}") for t in range(70)]
    rows = [(1000 + 20 * k, *p) for k in range(0, 60, 3) for p in path[: k + 1]]
    rows += [(3000 + 20 * k, *p) for k in range(0, 60, 7) for p in [*path[: k + 1], (k + 1, "user", f"other {k}")]]
    rows += [(c, *p) for c in range(8000, 8100) for p in path[:9]]
    rows += [(9000, 1, "user", "same"), (9000, 1, "user", "same"), (9000, 1, "assistant", "b"), (9000, 1, "assistant", "a")]
    assert nodes(llm, rows) == plain.trie(rows)


def test_nothing_and_turnless(llm):
    assert nodes(llm, []) == []
    short = [(c, 0, "user", "hi there") for c in (21, 22, 23, 24, 25)]
    assert nodes(llm, short) == plain.trie(short)


def test_long_text(llm):
    rows = [(c, t, "user", ("word " * 300_000) + str(t)) for c in (40, 43) for t in range(2)]
    assert nodes(llm, rows) == plain.trie(rows)


def test_fattest(llm):
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 40)]
    got = llm.createDataFrame(pairs, "a long, b long").select("a", "b", trie.fattest("a", "b").alias("f")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: (x & -x, x))


def test_exit_nodes_of_strings_outside(llm):
    """Fat binary search meets the deepest node of a path, also for a string that is in no batch."""
    turns = llm.createDataFrame([(c, d, "user", str(x)) for c, path in {1: "aaaaaaaabb", 2: "aaaaaaaacc", 3: "aaaa"}.items() for d, x in enumerate(path, 1)], "c long, d long, role string, text string")
    steps = trie.prefixes(turns)
    full = steps.groupBy("c").agg(F.max(F.struct("d", "k", "upto")).alias("x")).select(F.col("c").alias("s"), F.col("x.d").alias("len"), F.col("x.k").alias("key"), "x.upto")
    built = trie.build(full, steps)
    assert sorted((r["a"], r["b"]) for r in built.collect()) == [(0, 4), (4, 8), (8, 10), (8, 10)]
    probe = llm.createDataFrame([(9, d, "user", str(x)) for d, x in enumerate("aaaaaaaabxyz", 1)], "c long, d long, role string, text string")
    own = trie.prefixes(probe)
    key = own.groupBy("c").agg(F.max(F.struct("d", "k", "upto")).alias("x")).select(F.col("c").alias("s"), F.col("x.d").alias("len"), F.col("x.k").alias("key"), "x.upto")
    (row,) = trie.locate(key, built, steps.unionByName(own), 4).collect()
    assert row["lo"] == 8 or row["exit"] in {r["k"] for r in built.where("a = 8").collect()}


def test_search_plans_one_level_at_a_time(llm):
    """The plan of a search does not grow with the levels: longer conversations have more of them."""
    turns = llm.createDataFrame([(c, d, "user", str(d)) for c in (1, 2) for d in range(1, 5 + c)], "c long, d long, role string, text string")
    steps = trie.prefixes(turns)
    strings = steps.groupBy("c").agg(F.max(F.struct("d", "k", "upto")).alias("x")).select(F.col("c").alias("s"), F.col("x.d").alias("len"), F.col("x.k").alias("key"), "x.upto")
    steps, strings = trie.stored(steps, "steps"), trie.stored(strings, "strings")
    nodes = trie.stored(trie.build(strings, steps), "nodes")
    joins = [trie.locate(strings, nodes, steps, levels)._jdf.queryExecution().optimizedPlan().toString().count("Join") for levels in (1, 4)]
    assert joins == [1, 1]
