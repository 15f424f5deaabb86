import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sinew.ordered import Scan, asof_backward, asof_nearest, chunk_of, dense_index, interval_join, running, with_halo


def test_running_equals_plain_scan(spark):
    rng = np.random.default_rng(1)
    frame = pd.concat([
        pd.DataFrame({"session_id": s, "k": np.arange(n), "v": rng.normal(size=n), "e": rng.random(n) < 0.2}) for s, n in enumerate((1, 57, 200))
    ])
    frame["mark"] = frame["k"].where(frame["e"])
    df = spark.createDataFrame(frame)
    mark = F.when(F.col("e"), F.col("k"))
    out = running(df, ["session_id"], ["k"], chunk_of("k", 8), {
        "total": Scan("sum", F.col("v")), "top": Scan("max", F.col("v")), "low": Scan("min", F.col("v")),
        "prev": Scan("last", mark), "prev_x": Scan("last", mark, exclusive=True), "opening": Scan("first", mark),
        "next": Scan("last", mark, reverse=True),
    }).toPandas().sort_values(["session_id", "k"])
    for s, got in out.groupby("session_id"):
        want = frame[frame["session_id"] == s]
        np.testing.assert_allclose(got["total"], want["v"].cumsum())
        np.testing.assert_allclose(got["top"], want["v"].cummax())
        np.testing.assert_allclose(got["low"], want["v"].cummin())
        np.testing.assert_array_equal(got["prev"].to_numpy(float), want["mark"].ffill().to_numpy(float))
        np.testing.assert_array_equal(got["prev_x"].to_numpy(float), want["mark"].ffill().shift().to_numpy(float))
        np.testing.assert_array_equal(got["next"].to_numpy(float), want["mark"].bfill().to_numpy(float))
        first = want["mark"].dropna().min()
        expected = np.where(want["k"] >= first, first, np.nan)
        np.testing.assert_array_equal(got["opening"].to_numpy(float), expected)


def test_no_stage_sorts_a_whole_session(spark):
    """Rows are only ever partitioned by (key, chunk); the key alone is used on chunk summaries."""
    df = spark.range(1000).select((F.col("id") % 2).alias("session_id"), F.col("id").alias("k"), F.lit(1).alias("v"))
    plan = running(df, ["session_id"], ["k"], chunk_of("k", 10), {"t": Scan("sum", F.col("v"))})
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    whole = [line for line in text.splitlines() if "Window" in line and "[session_id" in line and "_chunk" not in line.split("],")[-2]]
    assert all("_sum_t" in line or "_carry" in line for line in whole)


def test_halo_rejects_reach_beyond_a_chunk(spark):
    with pytest.raises(ValueError):
        with_halo(spark.range(3).withColumnRenamed("id", "i"), "i", 4, before=5)


def test_dense_index(spark):
    rows = [(s, float((7 * n) % 50)) for s in range(2) for n in range(50)]
    df = spark.createDataFrame(rows, "session_id long, at double")
    got = dense_index(df, ["session_id"], ["at"], F.floor(F.col("at") / 9)).toPandas()
    assert (got["i"] == got["at"]).all()


def test_asof_joins(spark):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"session_id": 0, "t": np.sort(rng.uniform(0, 100, 200))})
    right = pd.DataFrame({"session_id": 0, "u": np.sort(rng.uniform(10, 90, 15)), "name": [f"n{i}" for i in range(15)]})
    got = asof_backward(spark.createDataFrame(left), spark.createDataFrame(right), ["session_id"], "t", "u", ["name"], width=3.0)
    want = pd.merge_asof(left, right, left_on="t", right_on="u", by="session_id")
    a = got.toPandas().sort_values("t")["name"].fillna("-").tolist()
    assert a == want["name"].fillna("-").tolist()
    near = asof_nearest(spark.createDataFrame(left), spark.createDataFrame(right), ["session_id"], "t", "u", ["name"], width=3.0)
    want = pd.merge_asof(left, right, left_on="t", right_on="u", by="session_id", direction="nearest")
    assert near.toPandas().sort_values("t")["name"].tolist() == want["name"].tolist()


def test_interval_join_has_no_width_effect(spark):
    points = spark.createDataFrame([(0, float(t) / 10) for t in range(100)], "session_id long, t double")
    spans = spark.createDataFrame([(0, "a", 1.0, 3.0), (0, "b", 3.0, 7.5)], "session_id long, n string, lo double, hi double")
    results = []
    for width in (0.5, 100.0):
        out = interval_join(points, spans, ["session_id"], F.col("t"), "lo", "hi", ["n"], width=width)
        results.append(sorted((r.t, r.n or "") for r in out.collect()))
    assert results[0] == results[1] and len(results[0]) == 100
    assert dict(results[0])[3.0] == "b" and dict(results[0])[7.5] == ""
