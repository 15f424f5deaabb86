import inspect
from collections import Counter
from pathlib import Path

import plain
import public_tokenizers
import pytest
from test_classifiers import corpus_of

import corpus_pipeline
from sinew.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def folder(llm, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, lang, f"s{i % 4}", len(t)) for i, t, lang, _, _ in corpus_of(400)]
    item = "this benchmark passage has more than ten words so that a window of it is found"
    rows += [(1000, rows[5][1], "en", "s1", 1), (1001, "before it. " + item.upper() + " after it.", "en", "s2", 90), (1002, None, None, None, None), (1003, "", "en", "s0", 0)]
    llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    llm.createDataFrame([(i, x, q) for i, _, _, x, q in corpus_of(400) if i % 2], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    llm.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(llm, folder):
    toxic = {i for i, _, _, x, _ in corpus_of(400) if x}
    docs = llm.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.toxicity(llm, docs, folder)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(toxic & ids) < 0.3 * len(toxic) and len(ids - toxic) > 0.95 * (404 - len(toxic))
    unique = corpus_pipeline.near_duplicates(llm, docs, folder)
    classes = plain.simhash_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert unique.columns == docs.columns and sorted(r["doc_id"] for r in unique.collect()) == sorted({c for _, c in classes.values()})
    clean = corpus_pipeline.decontamination(llm, docs, folder)
    assert clean.columns == docs.columns
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert text[1001] == "before it. \n after it." and text[1000] is not None and text[1002] is None
    mix = corpus_pipeline.mixing(llm, docs, folder)
    assert mix.columns == docs.columns
    counts = Counter(r["doc_id"] for r in mix.collect())
    assert max(counts.values()) <= 3
    ids_ = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.token_ids(llm, docs, folder).collect()}
    assert ids_ == plain.tokens([(r["doc_id"], r["text"]) for r in docs.collect()], public_tokenizers.path("byte_bpe_50k.json"))


def test_run(llm, folder):
    docs = llm.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = llm.createDataFrame(stage(llm, docs, folder).collect(), docs.schema)
    expected = Counter(r["doc_id"] for r in docs.collect())
    found = corpus_pipeline.run(llm, folder).collect()
    assert Counter(r["doc_id"] for r in found) == expected
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
    assert set(ORACLES) <= set(QUERIES)
    package = Path(inspect.getfile(corpus_pipeline)).parent / "sinew"
    for source in package.rglob("*.py"):
        if "llm" not in source.parts:
            assert "sinew.llm" not in source.read_text()
