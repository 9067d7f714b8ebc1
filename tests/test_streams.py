"""Streams over bounded input give what the batch operators give, and resume from their checkpoints."""

import datetime
import uuid

from docweft.streaming import streams
from pyspark.sql import functions as F

SCHEMA = "event_id long, user_id long, status string, ts timestamp"


def events(spark, n=60):
    t = datetime.datetime(2026, 1, 1)
    rows = [(i, i % 7, ["Received", "Stored", "Processed"][i % 3], t + datetime.timedelta(minutes=3 * i)) for i in range(n)]
    return spark.createDataFrame(rows + rows[:20], SCHEMA)


def run(spark, df, mode):
    name = f"t{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, tmp_path):
    events(spark).repartition(4).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return streams.read_bounded(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=4)


def test_deduplication(spark, tmp_path):
    out = run(spark, streams.deduplicated(source(spark, tmp_path), ["event_id"], "ts"), "append")
    assert sorted(r.event_id for r in out.collect()) == list(range(60))


def test_latest_status_equals_batch(spark, tmp_path):
    out = run(spark, streams.latest_status(source(spark, tmp_path), "user_id", "ts", "status", "event_id"), "complete")
    batch = streams.latest_status(events(spark), "user_id", "ts", "status", "event_id")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_window_counts_equal_batch(spark, tmp_path):
    out = run(spark, streams.window_counts(source(spark, tmp_path), "ts", "status", "1 hour"), "complete")
    batch = streams.window_counts(events(spark), "ts", "status", "1 hour")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_watchdog(spark):
    now = F.lit("2026-01-01 03:00:00").cast("timestamp")
    got = streams.stalled(events(spark), "user_id", "ts", "status", "event_id", {"Stored": 5, "Received": 500}, now)
    assert {r.user_id for r in got.collect()} == {r.user_id for r in streams.latest_status(events(spark), "user_id", "ts", "status", "event_id").where("status = 'Stored'").collect() if (datetime.datetime(2026, 1, 1, 3) - r["at"]).total_seconds() > 300}


def test_bounded_batches_resume(spark, tmp_path):
    path, seen = str(tmp_path / "in"), []
    events(spark, 10).dropDuplicates(["event_id"]).coalesce(1).write.parquet(path)

    def each(batch, n):
        seen.append(streams.batch_bounds(batch, "event_id").first())

    for expected in (1, 1, 2):
        if expected == 2:
            events(spark, 10).limit(3).coalesce(1).write.mode("append").parquet(path)
        streams.run_available(streams.read_bounded(spark, path, spark.read.parquet(path).schema), str(tmp_path / "check"), each)
        assert len(seen) == expected
    assert (seen[0].first_item, seen[0].last_item, seen[0]["items"]) == (0, 9, 10)


def test_late_rows_and_known_keys(spark):
    on_time, late = streams.split_late(events(spark), "ts", F.lit("2026-01-01 02:00:00").cast("timestamp"))
    assert on_time.count() + late.count() == 80 and late.select(F.max("ts")).first()[0] < datetime.datetime(2026, 1, 1, 1)
    target = events(spark).where("event_id < 50").select("event_id")
    assert sorted(r.event_id for r in streams.new_keys_only(events(spark), target, ["event_id"]).collect()) == list(range(50, 60))
