import numpy as np
from pyspark.sql import functions as F

from helpers import hysteresis, proba_frame, probabilities, samples, vote_debounce
from sinew.operators import calibrate as C
from sinew.operators import features as FE
from sinew.operators import models as M
from sinew.operators import proportional as P
from sinew.operators import smooth as SM
from sinew.operators import windows as W
from sinew.streaming import live as LV
from sinew.streaming import outputs as LO
from sinew.streaming import runs as RN


def cut(df, order, edges):
    bounds = [-1, *edges, 10**9]
    return [df.filter((F.col(order) > a) & (F.col(order) <= b)) for a, b in zip(bounds[:-1], bounds[1:])]


def test_windows_over_triggers_with_a_hole(spark):
    df, _ = samples(spark, 900, 333)
    holed = df.filter("not (session_id = 0 and i between 410 and 415)")
    batch = {(r.session_id, r.k): r.x for r in W.sliding_windows(holed).collect()}
    stream = {(r.session_id, r.k): r.x for r in RN.replay(cut(holed, "i", [99, 140, 412, 600]), LV.stream_windows).collect()}
    assert batch.keys() == stream.keys()
    assert batch == stream


def test_continuous_features_over_triggers(spark):
    df, _ = samples(spark, 1900)
    batch = {r.k: r.f for r in FE.extract_features(df, continuous=True, first=25).collect()}
    stream = {r.k: r.f for r in RN.replay(cut(df, "i", [333, 1200]), lambda s: LV.stream_features(s, continuous=True, first=25)).collect()}
    assert batch.keys() == stream.keys()
    for k in batch:
        np.testing.assert_allclose(batch[k], stream[k], rtol=1e-6, atol=1e-6)


def test_late_rows_are_dropped(spark):
    df, _ = samples(spark, 600)
    first, second = cut(df, "i", [400])
    late = first.filter("i between 100 and 120").withColumn("ch0", F.lit(0.0))
    a = {r.k: r.x for r in RN.replay([first, second.unionByName(late)], LV.stream_windows).collect()}
    b = {r.k: r.x for r in W.sliding_windows(df).collect()}
    assert a == b


def test_smoothing_over_triggers(spark):
    p = {s: probabilities(n, s) for s, n in enumerate((90, 17))}
    out = RN.replay(cut(proba_frame(spark, p), "k", [10, 40]), LV.stream_smooth)
    got = {(r.session_id, r.k): r.output for r in out.collect()}
    assert got == {(s, k): v for s, x in p.items() for k, v in enumerate(hysteresis(x))}


def test_live_prediction_equals_the_batch_chain(spark):
    df, _ = samples(spark, 2500)
    rng = np.random.default_rng(0)
    model = M.LinearModel(("a", "b", "c"), rng.normal(0, 0.2, (3, 69)), np.zeros(3))
    stream = RN.replay(cut(df, "i", [700, 1500]), lambda s: LV.stream_predict(s, model, calibration_windows=20))
    got = {r.k: (r.winner, r.output) for r in stream.collect()}
    features = FE.extract_features(df, continuous=True, first=25)
    stats = C.rest_calibration(features, seconds=0.1)
    calibration = C.to_vectors(stats, ["session_id"], ["mu", "sigma"])
    scored = M.score(C.apply_calibration(features.filter("k >= 20"), calibration), model)
    batch = SM.smooth_hysteresis(scored.withColumn("k", F.col("k") - 20), 3)
    assert got == {r.k + 20: (r.winner, r.output) for r in batch.collect()}


def test_silence_raises_an_alarm(spark):
    def rows(*pairs):
        text = spark.createDataFrame(list(pairs), "session_id long, ms long")
        return text.select("session_id", F.timestamp_millis("ms").alias("at"))

    t = 1_700_000_000_000
    steps = [rows((0, t), (1, t)), rows((1, t + 2000)), rows((1, t + 5000)), rows((1, t + 9000)), rows((1, t + 9500))]
    got = RN.replay(steps, LV.silence_alarms).collect()
    assert (0, t) in {tuple(r) for r in got}
    assert (1, t + 9500) not in {tuple(r) for r in got}


def test_quality_is_observed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1,2,3,4\nbad\n5,6,7,8\n")
    lines = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "line")
    query = LV.observed(lines).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p.observedMetrics["quality"] for p in query.recentProgress if "quality" in p.observedMetrics]
    assert sum(m.parsed for m in seen) == 2 and sum(m.rejected for m in seen) == 1


def test_votes_and_debounce_over_triggers_and_a_hole(spark):
    p = {s: probabilities(n, s + 3) for s, n in enumerate((150, 31, 2))}
    rows = proba_frame(spark, p).withColumn("k", F.expr("k + CASE WHEN session_id = 0 AND k >= 50 THEN 7 ELSE 0 END"))
    batch = {(r.session_id, r.k): tuple(r)[2:] for r in SM.smooth_vote_debounce(rows, 4).collect()}
    for edges in ([10, 40], [0, 1, 2, 3, 25, 26, 60]):
        out = RN.replay(cut(rows, "k", edges), LO.stream_vote_debounce)
        got = {(r.session_id, r.k): tuple(r)[2:] for r in out.select(*SM.smooth_vote_debounce(rows, 4).columns).collect()}
        assert got.keys() == batch.keys()
        for key, (raw, winner, conf, rejected, majority, confidence, output) in batch.items():
            assert got[key][:2] == (raw, winner) and got[key][3:5] == (rejected, majority) and got[key][6] == output
            assert abs(got[key][2] - conf) < 1e-12 and abs(got[key][5] - confidence) < 1e-12
    assert {s: [batch[s, k][-1] for k in sorted(k for t, k in batch if t == s)] for s in p} == {s: vote_debounce(x) for s, x in p.items()}


def test_vote_options_over_triggers(spark):
    p = {0: probabilities(80, 11)}
    for options in ({"reject": 0.0}, {"votes": 1, "debounce": 1}, {"debounce": 5, "keep": 0.3}):
        batch = {r.k: r.output for r in SM.smooth_vote_debounce(proba_frame(spark, p), 4, **options).collect()}
        out = RN.replay(cut(proba_frame(spark, p), "k", [6, 41]), lambda s: LO.stream_vote_debounce(s, **options))
        assert {r.k: r.output for r in out.collect()} == batch
    changes = RN.replay(cut(proba_frame(spark, p), "k", [6, 41]), lambda s: LO.stream_vote_debounce(s, on_change=True))
    full = SM.prediction_events(SM.smooth_vote_debounce(proba_frame(spark, p), 4))
    assert sorted((r.k, r.output) for r in changes.collect()) == sorted((r.k, r.output) for r in full.collect())


def test_written_angles_over_triggers_and_a_hole(spark):
    rng = np.random.default_rng(5)
    rows = [(s, k + (9 if k > 70 else 0), float(v)) for s, n in enumerate((200, 5)) for k, v in enumerate(np.clip(0.4 + np.cumsum(rng.normal(0, 0.08, n)), 0, 1))]
    levels = spark.createDataFrame(rows, "session_id long, k long, level double")
    batch = P.write_filter(P.slew_limit(P.level_ema(levels))).collect()
    want = {(r.session_id, r.k): r.angle for r in batch}
    for edges in ([60, 120], [0, 3, 4, 78, 79]):
        got = {(r.session_id, r.k): r.angle for r in RN.replay(cut(levels, "k", edges), LO.stream_write_filter).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[key] - angle) < 1e-9 for key, angle in want.items())


def test_late_lost_and_repeated_rows_are_counted(spark):
    rows = spark.createDataFrame([(s, i) for s in range(2) for i in range(60)], "session_id long, i long")
    lost = rows.filter("NOT (session_id = 0 AND i IN (5, 6, 30))")
    first, second, third = cut(lost.filter("NOT (session_id = 1 AND i IN (10, 25))"), "i", [19, 39])
    late = rows.filter("session_id = 1 AND i IN (10, 25)")
    out = RN.replay([first, second.unionByName(second.filter("i = 33")), third.unionByName(late)], LV.stream_late_rows)
    got = {r.session_id: tuple(r)[1:] for r in out.groupBy("session_id").agg(F.sum("late"), F.sum("lost"), F.sum("repeated")).collect()}
    assert got == {0: (0, 3, 1), 1: (2, 2, 1)}


def test_time_windows_leave_the_state(spark):
    """Ten triggers in append mode: every window comes out once, and the state does not grow."""
    n = 4000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("session_id"), F.timestamp_millis(F.col("id")).alias("at"), F.col("id"), F.lit(2.0).alias("v"))
    progress = []
    parts = [*cut(rows, "id", [400 * k - 1 for k in range(1, 10)]), LV.heartbeat(rows)]
    out = RN.replay(parts, lambda s: LV.time_windows(s, ["v"], "100 milliseconds", "50 milliseconds", lateness="20 milliseconds"), progress=progress)
    got = sorted((r.start.timestamp(), r.n, r.v) for r in out.filter("session_id IS NOT NULL").collect())
    assert [g[1:] for g in got] == [(50, 2.0), *[(100, 2.0)] * 79, (50, 2.0)]
    kept = RN.state_rows(progress)
    assert len(kept) >= 10 and max(kept) <= 12 and kept[-1] <= 4


def test_rows_behind_the_watermark_are_counted(spark):
    rows = spark.range(100).select(F.lit(1).cast("long").alias("session_id"), F.timestamp_seconds(F.col("id")).alias("at"), F.col("id"))
    progress = []
    parts = [rows.filter("id < 50 AND id <> 3"), rows.filter("id >= 50 AND id < 70"), rows.filter("id >= 70 OR id = 3"), LV.heartbeat(rows)]
    out = RN.replay(parts, lambda s: LV.activity_sessions(s, "5 seconds", "1 second"), progress=progress)
    assert [r.n for r in out.filter("session_id IS NOT NULL").collect()] == [99]
    assert RN.dropped_by_watermark(progress) == 1
