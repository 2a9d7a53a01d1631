"""Streams over more files than a trigger reads, out of time order."""

import time

from strandflow.plans import catalog
from tests.oracle import compare, connect


def test_sessions_over_many_files_out_of_order(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").toPandas().sort_values("ts", ignore_index=True)
    (tmp_path / "events.parquet").mkdir()
    n = len(events)
    for k, part in enumerate([23, *range(22, -1, -1)]):
        events.iloc[n * part // 24 : n * (part + 1) // 24].to_parquet(tmp_path / "events.parquet" / f"{k:02d}.parquet", coerce_timestamps="us")
        time.sleep(0.02)
    assert compare(spark, "session_islands", catalog.QUERIES["session_islands"], catalog.ORACLES["session_islands"], str(tmp_path), connect(str(tmp_path))) == ""
