import random
import tracemalloc

import numpy as np
import plain
import pytest

from sinew.llm import parsing
from sinew.llm.parsing import Block, Step, first_of, repeats


def found(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("block_bytes,parts", [(4 << 20, 3), (2000, 4)])
def test_repeats(docs, corpus, block_bytes, parts):
    expected = plain.repeats(corpus)
    assert found(repeats(docs, block_bytes=block_bytes, parts=parts)) == expected
    assert sum(v[1] > 0 for v in expected.values()) > 12


def test_periods_and_edges(llm):
    rng = random.Random(9)
    base = "".join(rng.choice("ab") for _ in range(300))
    rows = [(k, t) for k, t in enumerate(["a" * 400, "b" + "a" * 60 + "c", base, base[100:149], base[100:150], "ab" * 200, base[:120] + "Z" + base[121:], "a" * 49, "é" * 30, "x" + "é" * 30])]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    assert found(repeats(df, block_bytes=300, parts=3)) == plain.repeats(rows)
    assert found(repeats(df.selectExpr("*", "1 AS block", "2 AS keys"), parts=2)) == plain.repeats(rows)


def test_null_and_equal_keys(llm, empty):
    text = "the quick brown fox jumps over the lazy dog and then it sleeps for a while"
    rows = [(5, text), (5, text), (None, text), (None, None), (4, "")]
    out = sorted((r["doc_id"] or 99, r["n_removed"]) for r in repeats(llm.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(4, 0), (5, 0), (5, 0), (99, 0), (99, len(text))]
    assert repeats(empty).count() == 0


def test_steps_hold_few_arrays_of_a_block():
    """Memory at the peak of each step, also if every window has to be compared: a multiple of the block's bytes."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(1500)]
    size = sum(map(len, texts))
    block = Block(list(range(len(texts))), list(map(len, texts)), "".join(texts).encode(), 50)
    notes, answers, peaks = [], [], []
    tracemalloc.start()
    for step in (Step.phrases, Step.groups, Step.windows, Step.removed):
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        made = step(block, notes, answers)
        peaks.append((tracemalloc.get_traced_memory()[1] - before) / size)
        if step is not Step.removed:
            answers.append(np.ones(len(made[0]), np.int64) if step is Step.groups else first_of(*made[:2]))
            notes.append(made[2])
    tracemalloc.stop()
    assert not made.any() and len(answers[2]) > 0.9 * size
    assert peaks[0] < 12 and peaks[1] < 30 and peaks[2] < 80 and peaks[3] < 60, peaks


def _block(seed, texts=300, size=400):
    rng = random.Random(seed)
    data = ["".join(rng.choice("abcdefgh ") for _ in range(size)) for _ in range(texts)]
    return Block(list(range(texts)), [size] * texts, "".join(data).encode(), 50)


def test_hash_parts_get_equal_shares_of_every_step():
    """Windows' least hashes are small numbers; sent as they are, the first of 20 parts would take three quarters of all."""
    block, notes, answers = _block(5), [], []
    for step in (Step.phrases, Step.groups, Step.windows):
        keys, rest, note = step(block, notes, answers)
        share = np.bincount((keys >> np.uint64(60)).astype(int), minlength=16) / len(keys)
        assert share.max() < 0.11, (step, share)
        notes.append(note)
        answers.append(np.ones(len(keys), np.int64) if step is Step.groups else first_of(keys, rest))


def test_sections_and_ranges_give_the_same_bytes(llm, docs, corpus, monkeypatch):
    """A block's windows and a hash part's keys are put in order some at a time, with the same results."""
    monkeypatch.setattr(parsing, "GROUP", 97)
    assert found(repeats(docs, parts=2)) == plain.repeats(corpus)
    block, notes, answers = _block(6, 20), [], []
    block.order[:] = 5
    for step in (Step.phrases, Step.groups, Step.windows):
        keys, rest, note = step(block, notes, answers)
        notes.append(note)
        answers.append(np.ones(len(keys), np.int64) if step is Step.groups else np.where(np.arange(len(keys)) % 3 == 0, 4, first_of(keys, rest)) if step is Step.windows else first_of(keys, rest))
    assert (np.diff(keys.astype(float)) < 0).sum() > 20
    goes = {key: a < 5 for key, a in zip(zip(keys.tolist(), rest[:, 0].tolist()), answers[2].tolist())}
    expected = np.zeros(len(block.data), bool)
    for at in range(len(block.data)):
        if block.owner[at] == block.owner[min(at + 49, len(block.data) - 1)] and at + 50 <= len(block.data):
            a, b = block.window_keys(np.array([at]))
            expected[at : at + 50] |= goes[int(a[0]), int(b[0])]
    assert (Step.removed(block, notes, answers) == expected).all() and expected.any()


def test_parts_grow_with_the_input(llm, monkeypatch):
    """Hash parts follow the bytes of text, also where the number of shuffle partitions stays."""
    taken = []
    monkeypatch.setattr(parsing, "PART_BYTES", 100)
    monkeypatch.setattr(parsing, "blocks_of", lambda docs, key, text, size, parts: taken.append(parts) or docs.limit(0).selectExpr("1L AS block"))
    monkeypatch.setattr(parsing, "answered", lambda rows, *rest: rows.limit(0))
    df = llm.createDataFrame([(k, "é" * 50) for k in range(40)] + [(41, None)], "doc_id long, text string")
    parsing.marked(df, "doc_id", "text", None, "n long")
    assert taken == [40]
