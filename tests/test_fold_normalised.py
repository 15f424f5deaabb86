import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sinew.operators import calibrate as C
from sinew.plans.workflows import fold_normalised


def expected(frame, fold):
    out = []
    for _, r in frame.iterrows():
        rest = frame[(frame.session_id == r.session_id) & (frame[fold] != r[fold])]
        if rest.empty:
            rest = frame[frame[fold] != r[fold]]
        x = np.stack(rest.f.tolist())
        mean = np.mean([np.stack(g.f.tolist()).mean(axis=0) for _, g in rest.groupby("label")], axis=0)
        out.append((np.array(r.f) - mean) / (x.std(axis=0) + C.EPSILON))
    return np.stack(out)


@pytest.mark.parametrize("fold", ["session_id", "part"])
def test_held_out_rows_have_no_part_in_their_statistics(spark, fold):
    rng = np.random.default_rng(2)
    rows = [(s, k, "ab"[int(rng.random() < 0.4)], k % 3, (1e6 + rng.normal(s, 1, 3)).tolist()) for s in range(4) for k in range(12)]
    frame = pd.DataFrame(rows, columns=["session_id", "k", "label", "part", "f"])
    frame.loc[(frame.session_id == 1) & (frame.part == 0), "label"] = "a"
    df = spark.createDataFrame(frame).withColumn("fold", F.col(fold))
    got = fold_normalised(df).orderBy("session_id", "k").collect()
    np.testing.assert_allclose(np.stack([r.f for r in got]), expected(frame, fold), rtol=1e-5, atol=1e-6)
