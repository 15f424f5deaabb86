import numpy as np
import plain
import public_tokenizers
import pytest

from sinew.llm import simhash, tokens
from sinew.llm.components import components
from sinew.llm.frames import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_near_duplicates(docs, corpus):
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == plain.simhash_components(corpus)
    assert len({c for _, c in found.values()}) < len(found) - 5


def test_null_keys_and_repeated_rows(llm):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (2, "z")]
    found = simhash.near_duplicates(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0] or -1, r[2] or -1) for r in found) == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 2)]
    kept = simhash.deduplicated(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0] or -1, r[1]) for r in kept if r[1]) == [(1, "a b c d e"), (2, "z")] and len(kept) == 3


def test_deduplicated_keeps_one_of_each_class(docs, corpus):
    classes = {c for _, c in plain.simhash_components(corpus).values()}
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(classes)


def test_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0


@pytest.mark.parametrize("n,most", [(300, 4), (3000, 3)])
def test_any_allocation_finds_all_pairs(n, most):
    rng = np.random.default_rng(n)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64)] * 2) ^ (np.uint64(1) << rng.integers(0, 63, 2 * n, dtype=np.uint64)))
    both = np.eye(64) * len(fps) / 2
    for size in (10, 10**5, 10**12):
        plan = simhash.allocate(size, both, most)
        left = np.concatenate([fps] * 1)
        close = {(int(a), int(b)) for i, a in enumerate(left) for b in left[i + 1 :][np.bitwise_count(left[i + 1 :] ^ a) <= most]}
        for a, b in close:
            x = a ^ b
            assert any((x & sum(1 << k for k in g)).bit_count() <= t for g, t in plan)


def test_forest_divides_large_sets(monkeypatch):
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)))

    def joined(a, b):
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist(), strict=True):
            assert (x ^ y).bit_count() <= 4
            root[find(y)] = find(x)
        return {f: find(f) for f in root}

    whole = joined(*simhash.forest(fps, 4))
    monkeypatch.setattr(simhash, "WIDE", 50)
    divided = joined(*simhash.forest(fps, 4))
    assert len(set(whole.values())) == len(set(divided.values())) == 1


def test_components(llm):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200), (300, 301), (301, 300)]
    found = {r["node"]: r["root"] for r in components(llm.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 301: 300}


def test_tokens(llm, docs, corpus):
    path = scratch(llm, "tokens")
    tokens.write_tokens(docs, path, PATH, parts=3)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.token_digest(llm, path).collect()}
    assert found == plain.tokens(corpus, PATH)
    some = [corpus[0][0], corpus[-1][0], 5000, None]
    rows = tokens.lookup(llm, path, llm.createDataFrame([(s,) for s in some], "doc_id long")).collect()
    assert {r["doc_id"]: (r["start"], len(r["ids"])) for r in rows} == {d: found[d][:2] for d in some[:2]}


def test_pieces_of_white_space_runs():
    from tokenizers import Tokenizer

    from sinew.llm.text import Texts

    runs = ["\n", "\t", "\n\n", "\n\n\n", "\n\n\n\n", "\t\t", "\t\t\t", " \n", "\n ", "\n  ", "  \n", "\r\n", "\r\n\r\n", "\n\t", " \n \n", "\u00a0\n", "\u2003\n", "\u3000 ", "\n\u00a0", "  ", "   ", "\x0b\x0c"]
    sides = ["", "a", "Z9", "7", "!", "'s", "'", "é", "中", "\u0301", "«", "€5"]
    cases = [left + run + right for run in runs for left in sides for right in sides]
    cases += ["a\n\nb" + c for c in cases[:200]]
    whole = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(cases, add_special_tokens=False)]
    raw = [c.encode() for c in cases]
    for size in (1, 50, len(cases)):
        encoder = tokens.Encoder(PATH)
        for a in range(0, len(cases), size):
            part = raw[a : a + size]
            ids, at = encoder.encode(Texts(np.frombuffer(b"".join(part), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])])))
            assert [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:], strict=True)] == whole[a : a + size]


def test_tokens_of_repeated_and_null_keys(llm):
    rows = [(7, "a"), (7, "b"), (7, "b"), (None, "c"), (None, None), (3, None)]
    path = scratch(llm, "tokens")
    tokens.write_tokens(llm.createDataFrame(rows, "doc_id long, text string"), path, PATH, parts=2)
    found = tokens.token_digest(llm, path).collect()
    assert sorted((r["doc_id"] or 99, r["n_tokens"]) for r in found) == [(3, 1), (7, 2), (7, 2), (7, 2), (99, 1), (99, 2)]
    assert sorted(r["start"] for r in found) == [0, 1, 3, 5, 7, 9] or sorted(r["start"] for r in found) == [0, 1, 3, 5, 7, 8]


def test_no_tokens(llm, empty):
    path = scratch(llm, "tokens")
    tokens.write_tokens(empty, path, PATH)
    assert tokens.token_digest(llm, path).count() == 0


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.choice(10**12, 3000, replace=False))
    index = tokens.Index.unpack(tokens.Index.build(keys, 0, np.arange(3001)).pack())
    assert [index.find(int(k)) for k in keys] == [(i, 1) for i in range(3000)]
    assert all(index.find(int(k)) == (0, 0) for k in rng.choice(10**12, 2000) if k not in keys)
