"""Numbering of samples: chunks that hold many rows each, and the same numbers as a plain sort."""

import datetime as dt
import random

from pyspark.sql import functions as F

from sinew.sources import testdata as td

SCHEMA = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_shipdate timestamp"
)


def test_samples_are_numbered_in_chunks_of_many_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    rows = [
        (n, n % 7, rng.randrange(2), 1, 1.0, 1000.0 + n, 0.0, 0.0, dt.datetime(1996, 1, 1) + dt.timedelta(days=rng.randrange(360))) for n in range(600)
    ]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "lineitem.parquet"))
    chunks, plain = [], td.dense_index

    def counted(df, keys, order, chunk, *more):
        chunks.append(df.select(*keys, chunk.alias("_c")).distinct().count())
        return plain(df, keys, order, chunk, *more)

    monkeypatch.setattr(td, "dense_index", counted)
    found = td.short_sessions(spark, str(tmp_path)).select("session_id", "i", F.round(F.col("ch1") * 1000).cast("long").alias("v")).collect()
    assert chunks[0] < len(rows) / 10
    want = {}
    for s in (0, 1):
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (r[8], r[0]))
        want.update({(s, i): 1000 + r[0] for i, r in enumerate(own)})
    assert {(r.session_id, r.i): r.v for r in found} == want
