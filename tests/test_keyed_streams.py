"""Keyed stream state, joins within a bound, late rows, the append log: equal to batch forms over out-of-order and repeated input."""

import datetime
import os
import random

import pytest
from docweft.operators import deliver
from docweft.streaming import keyed, sinks, streams
from pyspark.sql import functions as F

T0 = datetime.datetime(2026, 1, 1)
EVENTS = "event_id long, user_id long, status string, ts timestamp"


def minute(n):
    return T0 + datetime.timedelta(minutes=n)


def feed(spark, path, parts, schema):
    """Each part is a file of its own, in order."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return streams.read_bounded(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)


def run(stream, path, check):
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


@pytest.fixture()
def at(tmp_path, spark):
    keyed.use_state_store(spark)
    return str(tmp_path)


def test_watchdog_equals_batch(spark, at):
    rng = random.Random(3)
    rows = [(i, rng.randrange(6), rng.choice(["Received", "Stored", "Processed"]), minute(2 * i + rng.random())) for i in range(160)]
    rows.sort(key=lambda r: r[3].timestamp() + rng.random() * 1800)  # out of order by half an hour at most
    parts = [rows[i : i + 40] + rows[i : i + 9] + rows[max(0, i - 40) : i] for i in range(0, 160, 40)]
    limits = {"Received": 10, "Stored": 25}
    source = feed(spark, f"{at}/in", parts, EVENTS)
    run(keyed.watchdog(source, "user_id", "ts", "status", "event_id", limits), f"{at}/out", f"{at}/check")
    got = sorted(map(tuple, spark.read.parquet(f"{at}/out").collect()))
    end = max(r[3] for r in rows) - datetime.timedelta(hours=1)
    batch = spark.read.parquet(f"{at}/in")
    assert got == sorted(map(tuple, keyed.stall_periods(batch, "user_id", "ts", "status", "event_id", limits, F.lit(end)).collect()))
    assert len(got) > 20
    # those whose document has not moved since are what the batch watchdog reports
    open_now = {(r.user_id, r.status) for r in streams.stalled(batch.where(F.col("ts") <= F.lit(end)), "user_id", "ts", "status", "event_id", limits, F.lit(end)).collect()}
    last = {r[1]: r[3] for r in sorted(rows, key=lambda r: r[3]) if r[3] <= end}
    assert {(u, s) for u, s, t, _ in got if last[u] == t} == open_now


def test_watchdog_leaves_no_state_behind(spark, at):
    rows = [(1, 1, "Stored", minute(0)), (2, 1, "Processed", minute(5)), (3, 2, "Stored", minute(1)), (4, 9, "Processed", minute(500))]
    source = feed(spark, f"{at}/in", [rows, [(5, 9, "Processed", minute(600))]], EVENTS)
    query = keyed.watchdog(source, "user_id", "ts", "status", "event_id", {"Stored": 25}).writeStream.format("parquet").option("path", f"{at}/out")
    query = query.option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{at}/out").collect()] == [(2, "Stored")]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # only the newest row of document 9 and its timer are left


DELIVERIES = "document_id long, chat_id string, event_id long, at timestamp, action string, message_id long"


def deliver_answers(spark, at, parts, **options):
    keyed.run_answers(keyed.deliveries(feed(spark, f"{at}/in", parts, DELIVERIES), **options), f"{at}/out", f"{at}/check")
    return spark.read.parquet(f"{at}/out")


def test_claims_lease_and_states(spark, at):
    steps = [
        ("claim", 0, None, True, "pending", 1), ("claim", 5, None, False, "pending", 1), ("claim", 10, None, True, "pending", 2), ("message_sent", 11, 77, False, "message_sent", 2),
        ("claim", 12, None, False, "message_sent", 2), ("failed", 13, None, False, "failed", 2), ("claim", 14, None, True, "pending", 3), ("sent", 15, None, False, "sent", 3),
        ("claim", 500, None, False, "sent", 3), ("failed", 501, None, False, "sent", 3),
    ]
    rows = [(1, "c", i, minute(t), a, msg) for i, (a, t, msg, *_) in enumerate(steps)]
    out = deliver_answers(spark, at, [rows[:4] + rows[:2], rows[2:7], rows[5:], rows]).orderBy("event_id").collect()
    assert [(r.granted, r.status, r.attempts) for r in out] == [s[3:] for s in steps]
    assert [r.resumable for r in out] == [i in (3, 4, 5, 6) for i in range(10)] and out[-1].message_id == 77


def test_deliveries_equal_the_fold_whatever_the_order(spark, at):
    """Attempts are as far apart as the lease, so that each claim is granted in any order; then the state is the fold's."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        action = rng.choice(["claim", "message_sent", "failed", "failed", "claim", "sent" if i % 9 == 0 else "failed"])
        rows.append((rng.randrange(8), f"c{rng.randrange(3)}", i, minute(30 * i), action, i if action == "message_sent" else None))
    ordered = deliver_answers(spark, at, [rows[i : i + 60] + rows[max(0, i - 30) : i] for i in range(0, 240, 60)])
    events = spark.createDataFrame(rows, DELIVERIES).select("document_id", "chat_id", F.expr("if(action = 'claim', 'pending', action)").alias("status"), "message_id", "at", "event_id")
    sent = events.where("status = 'sent'").groupBy("document_id", "chat_id").agg(F.min(F.struct("at", "event_id")).alias("end"))
    counted = events.join(sent, ["document_id", "chat_id"], "left").where("end IS NULL OR status <> 'pending' OR at < end.at")  # no claim is granted after sent
    fold = {(r.document_id, r.chat_id): (r.status, r.attempts, r.message_id, r.resumable) for r in deliver.fold_attempts(counted).collect()}
    last = ordered.join(events.select("event_id", "at"), "event_id").groupBy("document_id", "chat_id").agg(F.max_by(F.struct("status", "attempts", "message_id", "resumable"), F.struct("at", "event_id")).alias("s"))
    assert {(r.document_id, r.chat_id): tuple(r.s) for r in last.collect()} == fold


def test_late_arrivals_do_not_set_a_delivery_back(spark, at):
    rows = [(1, "c", 1, minute(0), "claim", None), (1, "c", 3, minute(20), "failed", None), (1, "c", 2, minute(10), "message_sent", 8), (1, "c", 0, minute(-30), "claim", None)]
    out = {r.event_id: r for r in deliver_answers(spark, at, [[r] for r in rows]).collect()}
    assert out[2].status == "failed" and out[2].message_id == 8 and out[2].resumable
    assert out[0].granted and out[0].status == "failed" and out[0].attempts == 2 and out[0].first_attempt_at == minute(-30)


def test_claims_of_one_batch_equal_the_batch_claim(spark, at):
    state = spark.createDataFrame([(1, "a", "sent", None, 2, None, None), (2, "a", "pending", minute(55), 1, None, None), (3, "a", "failed", minute(10), 4, None, None)],
        "document_id long, chat_id string, status string, locked_at timestamp, attempts int, first_attempt_at timestamp, last_attempt_at timestamp")
    asked = [(d, "a") for d in (1, 2, 3, 4)]
    want = {r.document_id: r.claimed for r in deliver.claim(state, spark.createDataFrame(asked, "document_id long, chat_id string"), F.lit(minute(60))).collect()}
    history = [
        (1, "a", 1, minute(0), "claim", None), (1, "a", 2, minute(1), "sent", None), (2, "a", 3, minute(55), "claim", None), (3, "a", 4, minute(10), "claim", None),
    ]
    out = deliver_answers(spark, at, [history, [(d, c, 10 + d, minute(60), "claim", None) for d, c in asked]])
    assert {r.document_id: r.granted for r in out.where("event_id > 10").collect()} == want


def test_unanswered_rows_once(spark, at):
    left = [(i, i % 5, minute(3 * i)) for i in range(60)]
    right = [(i % 5, minute(3 * i + 4)) for i in range(0, 60, 7)] * 2 + [(0, minute(400))]
    a = feed(spark, f"{at}/a", [left[:30], left[30:], [(99, 7, minute(500))]], "event_id long, user_id long, ts timestamp")
    b = feed(spark, f"{at}/b", [right[:8], right[8:], [(7, minute(500))]], "user_id long, answered_at timestamp")
    run(keyed.unanswered(a, b, "user_id", "ts", "answered_at", 20), f"{at}/out", f"{at}/check")
    end = minute(500 - 60 - 20)
    want = sorted(e for e, u, t in left if t < end and not any(v == u and t <= x <= t + datetime.timedelta(minutes=20) for v, x in right))
    assert sorted(r.event_id for r in spark.read.parquet(f"{at}/out").collect()) == want
    batch = keyed.unanswered(spark.read.parquet(f"{at}/a"), spark.read.parquet(f"{at}/b"), "user_id", "ts", "answered_at", 20)
    assert sorted(r.event_id for r in batch.where("event_id <> 99").collect()) == want


def test_late_rows_and_rows_on_time_are_the_input(spark, at):
    schema = "event_id long, ts timestamp"
    parts = [[(i, minute(i)) for i in range(100)], [(i, minute(i)) for i in range(90, 200)] + [(500, minute(3)), (501, minute(60))], [(500, minute(3)), (5, minute(5)), (502, minute(138)), (503, minute(140)), (None, minute(190))]]
    feed(spark, f"{at}/in", parts[:2], schema)
    table = spark.read.parquet(f"{at}/in").schema
    write = sinks.late_writer(spark, f"{at}/out", table, ["event_id"], "ts")

    def go(check):
        streams.run_available(streams.read_bounded(spark, f"{at}/in", table, files_per_trigger=1), check, write)

    def state():
        return sorted((r.event_id is None, r.event_id, r.late) for r in sinks.parted(spark, f"{at}/out", table).collect())

    go(f"{at}/check")
    feed(spark, f"{at}/in", parts[2:], schema)
    go(f"{at}/check")
    first = state()
    late = {500, 502}  # the newest row before is minute 99 for the second part and minute 199 for the third
    late.add(501) if 60 < 99 - 60 else None
    want = sorted((i is None, i, i in late) for i in {r[0] for p in parts for r in p})
    assert first == want
    # the last batch again, as after a failure before its commit
    commits = f"{at}/check/commits"
    last = max((n for n in os.listdir(commits) if n.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    go(f"{at}/check")
    assert state() == first
    # a new checkpoint reads all again: what is known stays as it is
    go(f"{at}/check2")
    assert [r for r in state() if not r[0]] == [r for r in first if not r[0]]


def test_append_log_commits_each_batch_once(spark, at):
    rows = [(i, i % 3, "Stored", minute(400 * i)) for i in range(20)]
    source = feed(spark, f"{at}/in", [rows[:8], rows[8:]], EVENTS)
    sinks.append_log(source, f"{at}/log", f"{at}/check", "ts")
    feed(spark, f"{at}/in", [[(20, 1, "Stored", minute(9000))]], EVENTS)
    sinks.append_log(source, f"{at}/log", f"{at}/check", "ts")
    assert sorted(r.event_id for r in spark.read.parquet(f"{at}/log").collect()) == list(range(21))
    for name in [n for n in os.listdir(f"{at}/check/commits") if n.strip(".").split(".")[0] == "2"]:
        os.remove(f"{at}/check/commits/{name}")
    sinks.append_log(source, f"{at}/log", f"{at}/check", "ts")
    log = spark.read.parquet(f"{at}/log")
    assert sorted(r.event_id for r in log.collect()) == list(range(21)) and "day" in log.columns
    sinks.append_log(feed(spark, f"{at}/twice", [rows[:5] + rows[:5], rows[3:6]], EVENTS), f"{at}/log2", f"{at}/check2", "ts", keys=["event_id"], watermark="9 days")
    assert sorted(r.event_id for r in spark.read.parquet(f"{at}/log2").collect()) == list(range(6))
