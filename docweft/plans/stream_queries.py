"""Registered queries of keyed stream state, stream sinks and snapshots over the given tables, each with the SQL of its batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.plans import model as m
from docweft.plans.queries import query
from docweft.sources import io
from docweft.sources.snapshots import SnapshotTable, changes
from docweft.streaming import keyed, sinks, streams

#: Events come in three files by time; the second and third have those of the file before again.
_CUTS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00")


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{io.shared_dir(spark)}/docweft/{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")


def _part(at: Column) -> Column:
    return F.when(at < F.lit(_CUTS[0]).cast("timestamp_ntz"), 0).when(at < F.lit(_CUTS[1]).cast("timestamp_ntz"), 1).otherwise(2)


def _files(spark: SparkSession, rows: DataFrame, part: Column, again: bool = True) -> str:
    """The folder of three files (by number), one after the other."""
    path = _fresh(spark, "arrivals")
    for n in range(3):
        now = rows.where(part == n)
        now.unionByName(rows.where(part.isin([n, n - 1]))).coalesce(1).write.mode("append").parquet(path) if again else now.coalesce(1).write.mode("append").parquet(path)
    return path


def _parts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in three micro-batches: half an hour out of order at most, each twice, and again with the next batch."""
    keyed.use_state_store(spark)
    e = _events(spark, sf_dir)
    path = _files(spark, e, _part(F.col("ts") - F.make_dt_interval(mins=F.col("event_id").cast("int") % 30)))
    return streams.read_bounded(spark, path, e.schema, files_per_trigger=1)


def _run(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """All that a stream in append mode gives."""
    path = _fresh(spark, name)
    out = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", _fresh(spark, "check"))
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


_LIMITS = {"signup": 240, "view": 360, "click": 720}


@query("""WITH n AS (SELECT user_id, event_type AS status, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx,
  to_minutes(CASE event_type WHEN 'signup' THEN 240 WHEN 'view' THEN 360 WHEN 'click' THEN 720 END) AS lim FROM events)
SELECT user_id, status, ts AS "at", ts + lim AS deadline FROM n WHERE lim IS NOT NULL AND (nx IS NULL OR nx > ts + lim)
  AND ts + lim <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stalled statuses by timers in event time."""
    found = _run(keyed.watchdog(_parts_stream(spark, sf_dir), "user_id", "ts", "event_type", "event_id", _LIMITS), spark, "stalls")
    return found.select("user_id", "status", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("at", "deadline")])


@query("""WITH e AS (SELECT user_id AS document_id, 'c' || (event_id % 4) AS chat_id, event_id, ts,
  CASE event_type WHEN 'purchase' THEN 'sent' WHEN 'click' THEN 'message_sent' WHEN 'error' THEN 'failed' ELSE 'claim' END AS action,
  CASE WHEN event_type = 'click' THEN event_id END AS message_id FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id, chat_id ORDER BY ts, event_id) AS n FROM e),
RECURSIVE_PLACEHOLDER
SELECT document_id, chat_id, status, attempts, message_id, message_id IS NOT NULL AND status IS DISTINCT FROM 'sent' AS resumable, first_at AS first_attempt_at, last_at AS last_attempt_at
FROM s QUALIFY n = max(n) OVER (PARTITION BY document_id, chat_id)""".replace("WITH e", "WITH RECURSIVE e").replace("RECURSIVE_PLACEHOLDER", """z AS (SELECT DISTINCT document_id, chat_id FROM o),
s AS (SELECT document_id, chat_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS status, 0 AS attempts, CAST(NULL AS BIGINT) AS message_id,
  CAST(NULL AS TIMESTAMP) AS lease, CAST(NULL AS TIMESTAMP) AS first_at, CAST(NULL AS TIMESTAMP) AS last_at FROM z
UNION ALL SELECT document_id, chat_id, n, CASE WHEN status = 'sent' THEN status WHEN action <> 'claim' THEN action WHEN ok THEN 'pending' ELSE status END,
  attempts + CASE WHEN ok THEN 1 ELSE 0 END, coalesce(new_message, message_id), CASE WHEN ok OR action = 'message_sent' THEN ts WHEN action = 'claim' THEN lease END,
  CASE WHEN ok THEN coalesce(first_at, ts) ELSE first_at END, CASE WHEN ok THEN ts ELSE last_at END
FROM (SELECT s.* EXCLUDE (n), o.n, o.action, o.ts, o.message_id AS new_message,
  o.action = 'claim' AND s.status IS DISTINCT FROM 'sent' AND NOT coalesce(s.lease > o.ts - INTERVAL 3 DAY, false) AS ok
  FROM s JOIN o ON o.document_id = s.document_id AND o.chat_id = s.chat_id AND o.n = s.n + 1))"""))
def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5: the last state of each delivery after claims and outcomes, batches repeated; a lease of three days, since events are far apart."""
    keyed.use_state_store(spark)
    action = F.when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "click", "message_sent").when(F.col("event_type") == "error", "failed")
    e = _events(spark, sf_dir).select(
        F.col("user_id").alias("document_id"),
        F.concat(F.lit("c"), F.col("event_id") % 4).alias("chat_id"),
        "event_id",
        F.col("ts").alias("at"),
        action.otherwise("claim").alias("action"),
        F.when(F.col("event_type") == "click", F.col("event_id")).alias("message_id"),
    )
    stream = streams.read_bounded(spark, _files(spark, e, _part(F.col("at"))), e.schema, files_per_trigger=1)
    path = _fresh(spark, "answers")
    keyed.run_answers(keyed.deliveries(stream, lease_minutes=3 * 24 * 60), path, _fresh(spark, "check"))
    answers = spark.read.parquet(path).join(e.select("event_id", "at"), "event_id")
    last = answers.groupBy("document_id", "chat_id").agg(F.max_by(F.struct("status", "attempts", "message_id", "resumable", "first_attempt_at", "last_attempt_at"), F.struct("at", "event_id")).alias("s"))
    out = last.select("document_id", "chat_id", "s.*")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_attempt_at", "last_attempt_at")})


@query("""SELECT event_id, user_id, ts AS "at" FROM events a WHERE event_type = 'view'
  AND ts + INTERVAL 2 HOUR < (SELECT min(t) - INTERVAL 1 HOUR FROM (SELECT max(ts) AS t FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type))
  AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'click' AND b.user_id = a.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 2 HOUR)""")
def stream_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that no click of the user follows within two hours, by an outer join of two streams."""
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    sides = [e.where(F.col("event_type") == kind).drop("event_type") for kind in ("view", "click")]
    left, right = (streams.read_bounded(spark, _files(spark, s, _part(F.col("ts").cast("timestamp_ntz")), again=False), s.schema, files_per_trigger=1) for s in sides)
    found = keyed.unanswered(left, right.select("user_id", F.col("ts").alias("clicked_at")), "user_id", "ts", "clicked_at", 120)
    return _run(found, spark, "unanswered").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("at"))


_ARRIVAL = """CASE WHEN event_id % 50 = 0 THEN 2 WHEN ts < TIMESTAMP '2024-01-11 00:00:00' THEN 0 WHEN ts < TIMESTAMP '2024-01-21 00:00:00' THEN 1 ELSE 2 END"""


@query(f"""WITH e AS (SELECT event_id, ts, {_ARRIVAL} AS part FROM events), w AS (SELECT part, max(ts) AS newest FROM e GROUP BY part)
SELECT event_id, coalesce(ts < (SELECT max(newest) FROM w WHERE w.part < e.part) - INTERVAL 1 HOUR, false) AS late FROM e""")
def stream_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on time and late, each once, over two runs; each row comes twice, and some come after the watermark."""
    e, path = _events(spark, sf_dir), _fresh(spark, "parted")
    arrival = F.when(F.col("event_id") % 50 == 0, 2).otherwise(_part(F.col("ts")))
    files, check = _files(spark, e, arrival), _fresh(spark, "check")
    for _ in range(2):
        streams.run_available(streams.read_bounded(spark, files, e.schema, files_per_trigger=1), check, sinks.late_writer(spark, path, e.schema, ["event_id"], "ts"))
    return sinks.parted(spark, path, e.schema).select("event_id", "late")


@query("""SELECT CAST(ts AS DATE) AS day, event_type AS status, count(*) AS n FROM events GROUP BY ALL""")
def stream_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream appended to a log by day in two runs, each event once."""
    e, path, check = _events(spark, sf_dir), _fresh(spark, "log"), _fresh(spark, "check")
    files = _files(spark, e, _part(F.col("ts")), again=False)
    for _ in range(2):
        sinks.append_log(streams.read_bounded(spark, files, e.schema, files_per_trigger=2), path, check, "ts")
    return spark.read.parquet(path).groupBy("day", F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


# --- snapshots -------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'inserted' ELSE 'changed' END AS change, CASE WHEN o_orderkey % 7 = 0 THEN 'Patched' ELSE o_orderstatus END AS status
FROM orders WHERE o_orderkey % 4 = 1 OR (o_orderkey % 7 = 0 AND o_orderkey % 4 <> 1)""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three versions of a table differ in: rows inserted where absent, then patched; a version rolled back and one that conflicts leave no trace."""
    o = m.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    table = SnapshotTable(spark, _fresh(spark, "orders"))
    first = table.create(o.where("id % 4 <> 1"), ["id"], parts=8)
    table.insert_absent(o.where("id % 2 = 1").withColumn("status", F.when(F.col("id") % 4 == 3, "Other").otherwise(F.col("status"))), "status")
    last = table.patch(o.where("id % 7 = 0").select("id", F.lit("Patched").alias("status")))
    table.patch(o.where("id % 5 = 0").select("id", F.lit("Undone").alias("status")))
    table.roll_back(last)
    found = changes(table.read(first), table.read(), ["id"])
    return found.join(table.read().select("id", "status"), "id")
