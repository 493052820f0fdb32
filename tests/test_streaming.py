import datetime as dt

from resight.streaming import rolling


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_rolling_state(spark, tmp_path):
    t = dt.datetime(2025, 1, 1)
    rows = [(i, i % 2, t + dt.timedelta(hours=i), [1.0, float(i % 2)]) for i in range(6)]
    schema = "frame_id long, individual_id long, ts timestamp, emb array<double>"
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {r["frame_id"]: r for r in run(spark, rolling.consistency(stream), "rolling_t")}
    assert len(found) == 6 and found[0]["score"] is None and abs(found[4]["score"] - 1) < 1e-9
    assert max(r["n_before"] for r in found.values()) == 2


def test_late_and_equal_times(spark, tmp_path):
    """Frames of one time don't meet, late ones meet what was before them, and those later than the delay nothing."""
    t, hour = dt.datetime(2025, 1, 1), dt.timedelta(hours=1)
    schema = "frame_id long, individual_id long, ts timestamp, emb array<double>"
    parts = [[(0, 1, t, [1.0, 0.0]), (1, 1, t, [1.0, 0.0]), (2, 1, t + 10 * hour, [0.0, 1.0])], [(3, 1, t + 5 * hour, [1.0, 0.0])], [(4, 1, t + 100 * hour, [1.0, 1.0])], [(5, 1, t + 40 * hour, [1.0, 0.0]), (6, 1, t + 100 * hour, [1.0, 1.0])]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in (tmp_path / "in").glob("part-*.parquet"):
            if not f.name.startswith("part-seen"):
                f.rename(tmp_path / "in" / f"part-seen{k}.parquet")
    import os

    for k in range(4):
        os.utime(tmp_path / "in" / f"part-seen{k}.parquet", (1_700_000_000 + 100 * k,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = {r["frame_id"]: (r["n_before"], None if r["score"] is None else round(r["score"], 6)) for r in run(spark, rolling.consistency(stream, "48 hours", "1000 days"), "late_t")}
    assert found == {0: (0, None), 1: (0, None), 2: (2, 0.0), 3: (2, 1.0), 4: (4, round(4 / (10 * 2) ** 0.5, 6)), 5: (None, None), 6: (4, round(4 / (10 * 2) ** 0.5, 6))}


def test_windows(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    assert len(run(spark, rolling.sightings(stream, "1 hour", watermark="1 hour"), "sightings_t")) > 0
    assert len(run(spark, rolling.sessions(stream, "10 minutes", "10 minutes"), "sessions_t")) > 0
