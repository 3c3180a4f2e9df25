"""Streams equal batches: complete mode for windows, state for the causal filter."""

import math

from signaloom.streaming import windows as ST

SF = "/root/testdata/sf0.001"


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, tmp_path):
    """Events as two files in the order of time."""
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id")
    rows = events.collect()
    for k, part in enumerate((rows[:600], rows[600:])):
        spark.createDataFrame(part, events.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*")), events


def test_windows(spark, tmp_path):
    live, events = stream(spark, tmp_path)
    a = run(spark, ST.tumbling(ST.timed(live), "1 day"), "tumbling", "complete").collect()
    b = ST.tumbling(ST.timed(events), "1 day").collect()
    key = lambda rows: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in rows)
    assert key(a) == key(b)
    a = run(spark, ST.sliding(ST.timed(live), "2 days", "1 day"), "sliding", "complete").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, ST.sliding(ST.timed(events), "2 days", "1 day").collect()))


def test_causal_filter(spark, tmp_path):
    live, events = stream(spark, tmp_path)
    a = {r.event_id: r.y for r in run(spark, ST.causal_stream(live, 0.2), "causal", "append").collect()}
    b = {r.event_id: r.y for r in ST.causal_batch(events, 0.2).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)
