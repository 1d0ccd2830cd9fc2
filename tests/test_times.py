"""Timestamps that go back, or whose first is just below a second, against the SQL."""

import datetime

import duckdb

from framepack import queries as core


def test_steps_back_and_rounded_start(spark, tmp_path):
    at = datetime.datetime(2024, 1, 3, 0, 58, 7, 999734)
    steps = {1: [0, 100], 2: [0, 10.5, -3.25, 2.1, -9.999], 3: [0, -7.7, -0.4, 0.4], 4: [0]}
    rows = [(k * 100 + i, k, at + datetime.timedelta(seconds=s)) for k, each in steps.items() for i, s in enumerate(each)]
    rows += [(900 + i, 9, datetime.datetime(1969, 12, 31, 23, 59, 50, 500700) + datetime.timedelta(seconds=s)) for i, s in enumerate([0, 3.3, -1.1])]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("timestamps_restored_by_user", "timestamp_deltas_events"):
        df = core.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({core.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
