import numpy as np
import pytest
from pyspark.sql import functions as F

from sinew.operators import labels as L


def labelled(spark, *tracks):
    rows = [(s, k, 0.025 * k, 0.025 * k + 0.149, label) for s, t in enumerate(tracks) for k, label in enumerate(t)]
    return spark.createDataFrame(rows, "session_id long, k int, start_time double, end_time double, label string")


TRACK = ["rest"] * 13 + ["fist"] * 20 + ["open"] * 3 + ["rest"] * 30 + ["fist"] * 16


def runs_of(track):
    edges = [0, *[i for i in range(1, len(track)) if track[i] != track[i - 1]], len(track)]
    return list(zip(edges[:-1], edges[1:]))


@pytest.mark.parametrize("size", [4, 7, 4096])
def test_forward_shift(spark, size):
    got = [r.label for r in L.forward_shift(labelled(spark, TRACK), size=size).orderBy("k").collect()]
    want = list(TRACK)
    for a, b in runs_of(TRACK):
        if TRACK[a] != "rest":
            want[a : min(a + 4, b)] = ["rest"] * (min(a + 4, b) - a)
    assert got == want


@pytest.mark.parametrize("size", [5, 4096])
def test_drop_transitions(spark, size):
    df = labelled(spark, TRACK)
    got = {r.k for r in L.drop_transitions(df, size=size).collect()}
    start = [0.025 * k for k in range(len(TRACK))]
    end = [0.025 * k + 0.149 for k in range(len(TRACK))]
    want = {k for a, b in runs_of(TRACK) for k in range(a, b) if not (start[k] < start[a] + 0.2 or end[k] > end[b - 1] - 0.15)}
    assert got == want


def test_one_label_is_one_run(spark):
    runs = L.with_runs(labelled(spark, ["fist"] * 40), size=8).collect()
    assert {r.run for r in runs} == {0} and {r.run_k for r in runs} == {0}
    assert {round(r.run_end, 3) for r in runs} == {round(0.025 * 39 + 0.149, 3)}


def test_schedule(spark):
    rows = L.prompt_schedule(spark.createDataFrame([(1,)], "session_id long"), ["open", "fist"], 3, 2, 2).orderBy("trial_id").collect()
    assert [r.gesture for r in rows] == ["rest", "open", "rest", "fist", "rest", "open", "rest", "fist", "rest"]
    starts = np.cumsum([0, *[r.duration for r in rows[:-1]]])
    assert [r.start for r in rows] == starts.tolist()


def test_unlabelled_outside_the_schedule(spark):
    schedule = L.prompt_schedule(spark.createDataFrame([(0,)], "session_id long"), ["open"], 0.5, 0.25, 1)
    got = L.label_windows(labelled(spark, ["x"] * 60).drop("label"), schedule).orderBy("k").collect()
    assert got[0].label == "rest" and got[-1].label == "unlabeled" and got[-1].trial_id == -1
    assert got[5].label == "open"  # 0.125 + 0.15 lies past 0.25


def test_late_boundary_holds_back_the_next(spark):
    df = labelled(spark, ["rest"] * 10 + ["fist"] * 10 + ["open"] * 20)
    marks = L.boundaries(df).withColumn("onset", F.when(F.col("label") == "fist", 0.8).otherwise(0.6))
    got = [r.aligned_label for r in L.apply_boundaries(df, marks, width=0.1, size=4).orderBy("k").collect()]
    want, current, pending = [], "rest", [(0.8, "fist"), (0.6, "open")]
    for k in range(40):
        while pending and 0.025 * k >= pending[0][0]:
            current = pending.pop(0)[1]
        want.append(current)
    assert got == want


def test_onset_fallback(spark):
    df = labelled(spark, ["rest"] * 20 + ["fist"] * 20)
    flat = spark.range(1200).select(F.lit(0).cast("long").alias("session_id"), F.col("id").alias("i"), (F.col("id") / 1000).alias("ts"), F.lit(1.0).alias("env"))
    found = L.detect_onset(L.boundaries(df), flat).first()
    assert found.onset == pytest.approx(0.5 + 0.3)
