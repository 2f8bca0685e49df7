"""The weekly roll-up as a Structured Streaming query (complete output mode)."""

import datetime as dt
import tempfile

from gridrisk.operators import panel


def test_weekly_rollup_streams(spark):
    rows = [(g, dt.date(2023, 1, 2) + dt.timedelta(days=i), i % 3, float(i)) for g in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "grid long, date date, accident long, exposure double")
    src = tempfile.mkdtemp(prefix="gridrisk-stream-", dir="/tmp")
    df.write.mode("overwrite").parquet(src)
    batch = panel.weekly_rollup(panel.with_week_key(df, "date"), ["grid", "year", "week"],
                                sums=["accident"], exposure="exposure")
    stream = spark.readStream.schema(df.schema).parquet(src)
    agg = panel.weekly_rollup(panel.with_week_key(stream, "date"), ["grid", "year", "week"],
                              sums=["accident"], exposure="exposure")
    q = agg.writeStream.outputMode("complete").format("memory").queryName("weekly_stream").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT grid, year, week, accident, exposure_sum FROM weekly_stream").collect())
    want = sorted(tuple(r) for r in batch.select("grid", "year", "week", "accident", "exposure_sum").collect())
    assert got == want and len(got) == 6
