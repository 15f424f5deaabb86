import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sinew.llm import positive_unlabelled as pu
from sinew.llm import toxicity as tox
from sinew.llm.labelled import best_cut, held_out


def corpus_of(n, seed=3):
    """(doc_id, text, lang, toxic, quality): toxic texts hold one of a few words or stems, poor ones are loud or full of symbols."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ["en", "de"][i % 3 == 0]
        words = [f"{lang}{rng.randrange(3000)}x" for _ in range(rng.randrange(20, 90))]
        toxic = rng.random() < 0.25
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "moron"]) if lang == "en" else f"lowei{rng.randrange(10**6)}"
        poor = rng.random() < 0.3
        if poor:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + rng.choice(["***", "$$$", "###"]) for w in words]
        rows.append((i, " ".join(words) + ".", lang, int(toxic), int(not poor)))
    return rows


@pytest.fixture(scope="module")
def labelled(llm):
    rows = corpus_of(1500)
    docs = llm.createDataFrame([r[:3] for r in rows] + [(9000, None, None), (9001, "", "en"), (9002, "x " * 3000, "fr"), (None, "idiot", "en")], "doc_id long, text string, lang string").selectExpr("*", "0 AS score", "'x' AS predicted", "'s' AS source")
    labels = llm.createDataFrame([(r[0], r[3], r[4]) for r in rows if r[0] % 2] + [(1, 1, None), (None, 1, 1), (77777, 0, 0)], "doc_id long, toxic int, quality int")
    return docs, labels, {r[0]: r for r in rows}


def area(score, label):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable")
    one = label == 1
    return (rank[one].mean() - (one.sum() - 1) / 2) / (~one).sum()


def check(found, truth, at, modulus, rest, cut, floor):
    assert len(found) == 1504
    rows = [r for r in found if r["doc_id"] in truth]
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest)
    score, label = np.array([r["score"] for r in rows]), np.array([truth[r["doc_id"]][at] for r in rows])
    unseen = np.array([r["held_out"] for r in rows])
    assert area(score[unseen], label[unseen]) > floor
    assert ((score >= cut) == label)[unseen].mean() > floor - 0.02


def test_toxicity(labelled):
    docs, labels, truth = labelled
    found = tox.toxicity(docs, labels).collect()
    check(found, truth, 3, 5, 0, 0.5, 0.95)
    again = {r["doc_id"]: r["score"] for r in tox.toxicity(docs.repartition(3), labels).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-4 for r in found)
    kept = tox.without_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if not r["toxic"]}


def test_quality(labelled):
    docs, labels, truth = labelled
    found = pu.quality(docs, labels).collect()
    check(found, truth, 4, 4, 2, 0.7, 0.97)
    kept = pu.good_only(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in found)


def test_nothing_to_learn_from(labelled):
    docs, labels, _ = labelled
    for df, table in ((docs.limit(5), labels.limit(0)), (docs.limit(0), labels), (docs.limit(0), labels.limit(0))):
        assert tox.toxicity(df, table).count() == df.count()
        assert pu.quality(df, table).count() == df.count()


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(2, 1, (2000, 3)), rng.normal(-2, 1, (2000, 3))
    web = np.concatenate([positive[:700], negative[:300]])
    scorer, prior = pu.fit(positive[700:], web)
    assert abs(prior - 0.7) < 0.1
    assert (scorer.logits(positive) > 0).mean() > 0.97 and (scorer.logits(negative[300:]) < 0).mean() > 0.97


def test_cut():
    assert 1 < best_cut(np.array([0.0, 1, 2, 3]), np.array([0, 0, 1, 1])) < 2
    assert best_cut(np.array([1.0, 2]), np.array([1, 1])) == 0.0


def test_network_step_lowers_loss():
    rng = np.random.default_rng(1)
    texts = [(rng.integers(0, tox.BUCKETS, n).astype(np.int32), rng.integers(0, tox.BUCKETS, n).astype(np.int32)) for n in [0, 5, 1, 9, 30, 0, 2, 7]]
    word, stem = (np.concatenate([t[k] for t in texts]) for k in (0, 1))
    first = np.concatenate([[0], np.cumsum([len(t[0]) for t in texts])])
    label = np.array([0, 1, 0, 1, 0, 0, 1, 1], np.float32)
    network, memory = tox.Network.start(np.zeros(tox.BUCKETS), np.zeros(tox.BUCKETS)), {}
    losses = [network.step(word, stem, first, label, np.ones(8, np.float32), memory, 0.05) for _ in range(60)]
    assert losses[-1] < 0.5 * losses[0]
    one = np.concatenate([network.logits(w, s, np.array([0, len(w)])) for w, s in texts])
    assert np.allclose(one, network.logits(word, stem, first), atol=1e-5)
    assert held_out("x", 5, 0) is not None


def test_toxicity_learns_from_all_labels(llm, monkeypatch):
    """Words that few of many shards hold are learnt; shards and tasks change nothing else."""
    rows = corpus_of(1800, seed=5)
    docs = llm.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = llm.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    monkeypatch.setattr(tox, "SHARD_ROWS", 300)
    seen = {}
    whole = tox.seen_words
    monkeypatch.setattr(tox, "seen_words", lambda rows: seen.setdefault("counts", whole(rows)))
    found = tox.toxicity(docs, labels).collect()
    learnable = sum(zlib.crc32(str(r[0]).encode()) % 5 != 0 for r in rows)
    assert seen["counts"][1].sum() + seen["counts"][2].sum() == learnable
    truth = {r[0]: r[3] for r in rows}
    unseen = [r for r in found if r["held_out"]]
    assert area(np.array([r["score"] for r in unseen]), np.array([truth[r["doc_id"]] for r in unseen])) > 0.95
    monkeypatch.setattr(tox, "TASKS", 2)
    again = {r["doc_id"]: r["score"] for r in tox.toxicity(docs.repartition(3), labels).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-3 for r in found)


def test_only_labelled_texts_are_shuffled(llm, monkeypatch):
    """Shards hold every row with a label and no other; of the rows without one few pass the filter before the shuffle."""
    rows = [(i % 9000 if i % 7 else None, f"text {i} " * (i % 5), "en" if i % 2 else None) for i in range(10000)]
    docs = llm.createDataFrame(rows, "key long, text string, lang string")
    labels = {k: k % 2 for k in [*range(0, 9000, 31), 10**9]}
    known = llm.createDataFrame(list(labels.items()), "key long, label int")
    wanted = sorted((k, x or "", t, labels[k]) for k, t, x in rows if k in labels)
    maybe = tox.maybe_known(docs, known, len(labels))
    assert maybe.columns == docs.columns
    found = [r["key"] for r in maybe.collect()]
    assert len(wanted) <= len(found) < len(wanted) + 1000 and {w[0] for w in wanted} <= set(found)
    monkeypatch.setattr(tox, "PIECE", 500)
    shard = F.pmod("key", F.lit(3)).cast("int")
    pieces = tox.packed(maybe.withColumn("shard", shard), known.withColumn("shard", shard)).toArrow()
    assert len(pieces) > 10
    tables = list(tox.shard_tables(iter(pieces.to_batches())))
    for t in tables:
        keys = t["key"].to_pylist()
        assert keys == sorted(keys) and len({k % 3 for k in keys}) == 1
    assert len(tables) == 3
    assert sorted((r["key"], r["lang"] or "", r["text"], r["label"]) for t in tables for r in t.to_pylist()) == wanted
