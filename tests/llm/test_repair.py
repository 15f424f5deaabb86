from __future__ import annotations

import random

import numpy as np
import plain
import pytest

from sinew.llm import repair
from sinew.llm.repair import audited, damaged

SCHEMA = "conv_id long, turn long, role string, text string, Turn_ string, cost int, C long"


def talk(seed: int, conversations: int, longest: int):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        shown = None if conv == 3 else conv - 1
        for turn in range(rng.randrange(longest + 1)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.5 else ["user", "assistant"][turn % 2]
            role = rng.choice([role, role, role, role, "system", "tool", "", None]) if conv % 2 else role
            text = rng.choice(["Yes.", "No", "a.  ", "ok! \n", " \t", "", None, f"t{turn}?", f"say {conv} {turn}.", "Ü"])
            number = None if rng.random() < 0.05 else turn // 2 if conv % 5 == 0 else turn * rng.choice([1, 1, 2])
            rows.append((shown, number, role, text))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", -1, 5) for r in rows], SCHEMA)


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("size", [1, 3, 128])
def test_equals_plain_repair(llm, size):
    """Whatever the length of chunks: nulls, empty roles, ties of turns, repeated rows, blank texts."""
    rows = talk(2, 40, 24)
    table = frame(llm, rows)
    found = audited(table, damaged(table), size=size)
    assert found.columns == COLUMNS
    assert result(found) == plain.audit(rows)


def test_one_long_conversation(llm):
    """A conversation of many chunks; its first rows decide nothing that a long way off is not corrected."""
    rng = random.Random(4)
    rows = [(7, t, "user" if t % 2 == (t > 300) else "assistant", rng.choice([f"Word {t}.", f"Word {t}.", f"word {t}", "Again."])) for t in range(700)]
    rows += [(8, t, "user", f"u {t}.") for t in range(90)]
    table = frame(llm, rows)
    assert result(audited(table, damaged(table), size=16)) == plain.audit(rows)


def test_nothing_left(llm):
    """No rows at all, and a conversation of which damage leaves none."""
    assert audited(frame(llm, []), damaged(frame(llm, []))).collect() == []
    gone = next(c for c in range(1000) if not plain.damage([(c, 0, "user", "x")])[c])
    table = frame(llm, [(gone, 0, "user", "x")])
    assert result(audited(table, damaged(table))) == plain.audit([(gone, 0, "user", "x")])
    assert result(audited(table)) == {gone: (0, 0, 0, 1, 0, 4 - 2, "D", plain.audit([(gone, 0, "user", "x")])[gone][-1])}


def test_long_text(llm):
    rows = [(1, 1, "user", "long " * 400_000 + "."), (1, 2, "assistant", "x" * 1_500_000 + "!"), (1, 3, "user", "end.")]
    table = frame(llm, rows)
    assert result(audited(table, damaged(table))) == plain.audit(rows)


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    """Passes from the successors' vectors end with the vectors of one run over the whole sequence."""
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 20, (30, 64))
    finish = np.tile(repair._FINISH, (30, 1))
    whole = repair.backward(codes, finish)
    left = repair.backward(codes[:, :32], finish)
    fixed = repair.backward(codes[:, :32], whole[:, 32], left)
    assert (fixed == whole[:, :33]).all()
    assert (left[:, :8] == fixed[:, :8]).all(axis=(1, 2)).mean() > 0.5
