from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sinew.llm.frames import ready  # noqa: E402


@pytest.fixture(scope="session")
def llm(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return ready(spark)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    words = [f"w{rng.randrange(vocabulary)}é"[: rng.randrange(3, 7)] for _ in range(n)]
    return "".join(w.capitalize() + rng.choice([" ", " ", " ", ", ", ".\n", "  "]) for w in words)


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int, str]]:
    """Texts with copies, near copies, passages in common, and odd ones."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    passage = prose(rng, 30)
    texts += [texts[3], texts[3], texts[4] + " tail", texts[5][:-3], "Intro: " + passage, passage + " outro", "x" + passage[7:] + passage]
    for k in range(8):
        words = texts[10 + k].split(" ")
        words[len(words) // 2] = f"changed{k}"
        texts.append(" ".join(words))
    texts += ["", None, "   \n\t ", "one", "MIT License", "ß" * 60 + " " + "ß" * 60, "a " * 400, "Ünïcode  wörds joined here 'll don't <|endoftext|> x<|endoftext|>", prose(rng, 6000)]
    ids = rng.sample(range(1000), len(texts))
    return sorted(zip(ids, texts, strict=True))


@pytest.fixture(scope="session")
def docs(llm, corpus):
    rows = [(d, t, "en" if d % 3 else "de", f"s{d % 4}", len(t or ""), -1, "no") for d, t in corpus]
    return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, Score string")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
