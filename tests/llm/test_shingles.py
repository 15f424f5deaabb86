import random

import numpy as np
import plain

import corpus_pipeline
from sinew.llm import shingles


def kept_by_all_pairs(rows):
    """Ids of the smallest of every component of texts with Jaccard >= 0.8 of five-word shingles, by comparing all."""
    sets = []
    for d, text in rows:
        w = plain.spaced((text or "").translate(plain.LOWER))
        sets.append((d, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if 5 * both >= 4 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted({find(d) for d in root})


def test_stage_finds_all_similar_texts(llm):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([100, 300, 1000]))]
        texts.append(" ".join(words))
        for _ in range(2):
            other = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * rng.choice([1, 2, 3]) // 100)):
                other[at] = f"new{rng.randrange(5000)}"
            texts.append(" ".join(other))
    # A long chain under common bands: the ends are not similar, neighbours are.
    chain = [f"c{k}" for k in range(400)]
    texts += [" ".join(chain[k : k + 200]) for k in range(0, 200, 10)]
    texts += ["One two", "one  two", "one two three", "", None, " \n"]
    rows = list(zip(rng.sample(range(5000), len(texts)), texts, strict=True))
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    expected = kept_by_all_pairs(rows)
    assert len(expected) < len(rows) - 80
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(llm, docs, "").collect()) == expected


def test_null_keys_repeated_rows_and_empty(llm, empty):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, None), (2, "z")]
    kept = shingles.deduplicated(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r[0] or -1, r[1]) for r in kept if r[1]) == [(1, "a b c d e"), (2, "z")] and len(kept) == 3
    assert shingles.deduplicated(empty).count() == 0


def test_keys_with_the_same_nodes_count_once(llm):
    """Of keys with equal members one stays, of others all; also when one has the other's members and one more."""
    rows = [(k, n) for k in (5, 3, 9) for n in (1, 2)] + [(4, 1), (4, 2), (4, 7), (6, 1), (6, 7)]
    members = llm.createDataFrame(rows, "key long, node long")
    found = sorted(map(tuple, shingles.distinct_keys(members).collect()))
    assert found == [(3, 1), (3, 2), (4, 1), (4, 2), (4, 7), (6, 1), (6, 7)]


def test_unlike_members_make_no_pairs(llm, monkeypatch):
    """A family under common keys whose texts share 0.5 of their shingles: none is compared by its set, all links are found."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:200], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])) for _ in range(60)]
    sets += [np.unique(np.append(s[:-20], rng.integers(0, 1 << 63, 5, dtype=np.uint64))) for s in sets[:10]]
    flat, first = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rows = [(i, s.tobytes(), k.tolist()) for i, (s, k) in enumerate(zip(sets, shingles.sketches(flat, first), strict=True))]
    table = llm.createDataFrame(rows, "node long, shingles binary, sketch array<long>")
    members = llm.createDataFrame([(key, i, len(s)) for key in range(3) for i, s in enumerate(sets)], "key long, node long, size int")
    compared, whole = [], shingles.similar
    monkeypatch.setattr(shingles, "similar", lambda pairs, least: compared.append(pairs.count()) or whole(pairs, least))
    assert sorted(map(tuple, shingles.links(members, table, 0.8).collect())) == [(60 + i, i) for i in range(10)]
    assert sum(compared) < 40
    apart = [(len(np.setxor1d(x, y)), np.bitwise_count((np.array(a[2]) ^ np.array(b[2])).view(np.uint64)).sum()) for x, a in zip(sets, rows, strict=True) for y, b in zip(sets, rows, strict=True)]
    assert all(differ >= bits for differ, bits in apart)


def test_stage_takes_candidates_from_simhash(llm, monkeypatch):
    """Copies with a changed word are found by their fingerprints alone, where bands give no candidates; texts without words are left out."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(1000)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate([*texts, *(t.rsplit(" ", 1)[0] + " other" for t in texts), "", None])]
    given, bare = [], shingles.by_fingerprint
    monkeypatch.setattr(shingles, "by_fingerprint", lambda prints: given.append(sorted(map(tuple, bare(prints).collect()))) or bare(prints))
    kept = corpus_pipeline.near_duplicates(llm, llm.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [*range(6), 12]
    (found,) = given
    keys = [key for key, _, _ in found]
    assert len(found) == 12 and sorted(keys.count(key) for key in set(keys)) == [2] * 6
