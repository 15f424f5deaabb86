import plain
from pyspark.sql import functions as F

from sinew.llm.quality_rules import filtered, judged, quantiles, sketches


def test_counts_and_base_rule(docs, corpus):
    text = dict(corpus)
    found = judged(docs).collect()
    assert len(found) == len(corpus)
    for r in found:
        expected = plain.quality(text[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r["base_failed"] and r["kept"])


def test_lines(llm):
    rows = [(1, "a\nb\na\n\n\na\nb"), (2, "\n"), (3, ""), (4, "x\nx\n"), (5, "x\n x"), (6, None)]
    found = {r["doc_id"]: r["n_dup_lines"] for r in judged(llm.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'l' lang", "'s' source")).collect()}
    assert found == {1: 3, 2: 0, 3: 0, 4: 1, 5: 0, 6: 0}


def test_outliers_fall_and_the_rest_stays(llm):
    plain_text = [" ".join(f"word{(i * 7 + k * k) % 997}" for k in range(100 + i % 30)) for i in range(300)]
    rows = [(i, t, "en", "s", 5) for i, t in enumerate(plain_text)]
    rows += [(1000, " ".join(f"w{k}***" for k in range(100)), "en", "s", 5), (1001, " ".join("x" * 90 + str(k) for k in range(60)), "en", "few", 5), (1002, "a " * 80, None, None, 5)]
    df = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    kept = {r["doc_id"] for r in judged(df).where("kept").collect()}
    assert kept == set(range(300))
    out = filtered(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == kept


def test_sketch_quantiles_are_close_and_merge(llm):
    df = llm.range(20_000).select((F.col("id") % 4).alias("g"), (F.pow(F.rand(3), 3) * 1000).alias("v"))
    sketch = sketches(df, ["g"], {"v": F.col("v")})
    found = quantiles(sketch.groupBy(F.lit(0).alias("g"), "metric", "bucket").agg(F.sum("n").alias("n")), ["g"], {"a": 0.1, "b": 0.9}).first()
    exact = df.selectExpr("percentile(v, 0.1) a", "percentile(v, 0.9) b").first()
    assert abs(found["a"] / exact["a"] - 1) < 0.02 and abs(found["b"] / exact["b"] - 1) < 0.02


def test_empty(empty):
    assert judged(empty).count() == 0
    assert filtered(empty).count() == 0
