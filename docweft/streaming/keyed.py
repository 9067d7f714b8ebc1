"""Keyed state in streams: the watchdog with timers (T3), claims and deliveries as a state machine (T4, T5), joins within a time bound.

Each stateful form has a batch function beside it that gives the same rows over the same input. State is kept by key in Spark's RocksDB store
(``use_state_store``), so a micro-batch reads and writes only the keys that it has rows for.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docweft.streaming.streams import WATERMARK

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = datetime.datetime(1970, 1, 1)


def use_state_store(spark: SparkSession) -> None:
    """Set the store that keyed state needs; once a session, before the first query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


# --- T3: watchdog ----------------------------------------------------------------------------------------------------


def stall_periods(rows: DataFrame, key: str, at: str, status: str, tie: str, limits: Mapping[str, int], until: Column) -> DataFrame:
    """T3 over a table: ``key, status, at, deadline`` of every status that lasted longer than its limit (minutes) by ``until``.

    A status ends with the key's next row by ``at`` and ``tie``; statuses without limit never stall. Equal rows count once.
    """
    order = Window.partitionBy(key).orderBy(at, tie)
    rows = rows.select(key, F.col(status).alias("status"), at, tie).distinct().withColumn("_next", F.lead(at).over(order))
    limit = F.element_at(F.create_map(*[x for s, n in limits.items() for x in (F.lit(s), F.lit(n))]), F.col("status"))
    rows = rows.withColumn("deadline", F.col(at) + F.make_dt_interval(mins=limit))
    late = (F.col("_next").isNull() | (F.col("_next") > F.col("deadline"))) & (F.col("deadline") <= until)
    return rows.where(late).select(key, "status", F.col(at).alias("at"), "deadline")


class Watchdog(StatefulProcessor):
    """One key's open rows; a timer at the earliest deadline, which sets the next one when it has passed (a call to the state's server
    for each row would cost far more than the row).

    Rows wait in the state until they are decided: a row with a successor within its limit is on time, one whose deadline the watermark
    has passed without a successor has stalled and is given out once. Decided rows leave the state when the watermark passes them, so a
    key that has come to a status without limit leaves nothing behind. Rows behind the watermark never arrive here, so a
    repeated batch changes nothing and rows that arrive out of order within the watermark are put in order first.
    """

    def __init__(self, limits: Mapping[str, int]):
        self.limits = {s: n * 60_000_000 for s, n in limits.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "rows string")  # as one value: each row of a list state is converted on its own

    def _deadline(self, row: tuple) -> int | None:
        return None if row[2] not in self.limits else row[0] + self.limits[row[2]]

    def _on_time(self, rows: list[tuple], i: int) -> bool:
        end = self._deadline(rows[i])
        return end is None or (i + 1 < len(rows) and rows[i + 1][0] <= end)

    def _ends(self, rows: list[tuple]) -> set[int]:
        """Times at which a row is decided or the last can go."""
        return {rows[-1][0]} | {self._deadline(r) for i, r in enumerate(rows) if not self._on_time(rows, i)}

    def _rows(self) -> list[tuple]:
        """Open rows (at, tie, status) in order."""
        held = self.open.get()
        return [] if held is None else [tuple(r) for r in json.loads(held[0])]

    def _keep(self, rows: list[tuple]) -> None:
        if rows:
            self.open.update((json.dumps(rows),))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self._rows()
        now = sorted({*before, *((r["_at"], r["_tie"], r["_status"]) for r in rows)})
        self.handle.registerTimer(-(-min(self._ends(now)) // 1000))  # one that stands already stays
        if now != before:
            self._keep(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows, kept, out = self._rows(), [], []
        for i, r in enumerate(rows):
            decided, end = self._on_time(rows, i), self._deadline(r)
            if not decided and end <= passed:
                out.append(Row(key=key[0], status=r[2], at=r[0], deadline=end))
            elif not decided or r[0] > passed:
                kept.append(r)
        if kept != rows:
            self._keep(kept)
        ends = {end for end in self._ends(kept) if end > passed} if kept else set()
        if ends:
            self.handle.registerTimer(-(-min(ends) // 1000))
        return iter(out)

    def close(self) -> None:
        pass


def watchdog(stream: DataFrame, key: str, at: str, status: str, tie: str, limits: Mapping[str, int], watermark: str = WATERMARK) -> DataFrame:
    """``key, status, at, deadline`` of each stalled status, once, when the watermark passes its deadline; append mode.

    Over bounded input the same rows as ``stall_periods`` until the last watermark.
    """
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark)
    given = rows.select(F.col(key).alias("_key"), at, micros(F.col(at)).alias("_at"), F.col(tie).cast("long").alias("_tie"), F.col(status).alias("_status"))
    kind = stream.schema[key].dataType.simpleString()
    found = given.groupBy("_key").transformWithState(Watchdog(limits), f"key {kind}, status string, at long, deadline long", "Append", "EventTime")
    return found.select(F.col("key").alias(key), "status", F.timestamp_micros("at").alias("at"), F.timestamp_micros("deadline").alias("deadline"))


# --- T4, T5: claims and deliveries ------------------------------------------------------------------------------------

DELIVERY = "status string, attempts int, message_id long, message_at long, message_tie long, first_at long, last_at long, at long, tie long"
ANSWER = (
    "document_id long, chat_id string, event_id long, action string, granted boolean, status string, attempts int, message_id long, resumable boolean, "
    "first_attempt_at long, last_attempt_at long"
)


class Deliveries(StatefulProcessor):
    """State of one (document_id, chat_id): pending, message_sent, then sent or failed.

    * ``claim`` is granted unless the delivery is ``sent`` (final) or leased: the lease is a value of its own that ends after the
      lease time and is dropped by its time to live; ``sent`` and ``failed`` give it back, ``message_sent`` takes it anew.
    * The status is that of the latest event by (at, event_id); an earlier one that arrives late counts but does not set it back.
    * A message id stays with failures, so that a later attempt resumes with the file (``resumable``).
    * Event ids that were seen are kept for ``remember`` and give no second answer, so a repeated batch changes nothing.
    """

    def __init__(self, lease_minutes: int, remember_hours: int):
        self.lease_micros, self.remember = lease_minutes * 60_000_000, remember_hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.delivery = handle.getValueState("delivery", DELIVERY)
        # the stored time decides; the time to live only clears what can matter no more, and late batches get as long as event ids
        self.lease = handle.getValueState("lease", "at long", self.lease_micros // 1000 + self.remember)
        # one list read and one appended to a batch: a look-up for each event would be a call to the state's server each
        self.seen = handle.getListState("seen", "event_ids array<long>", self.remember)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = {r["event_id"]: r for r in rows}
        for (event_ids,) in self.seen.get():
            for event_id in event_ids:
                new.pop(event_id, None)
        if not new:
            return
        d, lease = self.delivery.get(), self.lease.get()
        d = [None, 0, None, None, None, None, None, None, None] if d is None else list(d)
        before = leased = None if lease is None else lease[0]
        self.seen.appendValue((list(new),))
        for r in sorted(new.values(), key=lambda r: (r["_at"], r["event_id"])):
            at, tie, action = r["_at"], r["event_id"], r["action"]
            granted = action == "claim" and d[0] != "sent" and not (leased is not None and leased > at - self.lease_micros)
            newest = d[7] is None or (at, tie) > (d[7], d[8])
            if granted:
                d[1], d[5], d[6] = d[1] + 1, at if d[5] is None else min(d[5], at), at if d[6] is None else max(d[6], at)
            if granted or action != "claim":
                if d[0] != "sent" and (newest or action == "sent"):
                    d[0] = "pending" if action == "claim" else action
                if newest:
                    d[7], d[8] = at, tie
                    leased = at if action in ("claim", "message_sent") else None
                if r["message_id"] is not None and (d[3] is None or (at, tie) > (d[3], d[4])):
                    d[2], d[3], d[4] = r["message_id"], at, tie
            yield Row(
                document_id=key[0], chat_id=key[1], event_id=tie, action=action, granted=granted, status=d[0], attempts=d[1], message_id=d[2],
                resumable=d[2] is not None and d[0] != "sent", first_attempt_at=d[5], last_attempt_at=d[6],
            )
        self.delivery.update(tuple(d))
        if leased is not None:
            self.lease.update((leased,))
        elif before is not None:
            self.lease.clear()

    def close(self) -> None:
        pass


def deliveries(stream: DataFrame, lease_minutes: int = 10, remember_hours: int = 48) -> DataFrame:
    """T4, T5: an answer to each event (``document_id, chat_id, event_id, at, action, message_id``) with the delivery's state after it.

    ``action`` is claim, message_sent, sent or failed. In place of a table of claims that every micro-batch writes anew, each key's
    state is read and written where its rows are. Append mode; the last answer of a key is its state.
    """
    rows = stream.select("document_id", "chat_id", "event_id", micros(F.col("at")).alias("_at"), "action", F.col("message_id").cast("long").alias("message_id"))
    out = rows.groupBy("document_id", "chat_id").transformWithState(Deliveries(lease_minutes, remember_hours), ANSWER, "Append", "ProcessingTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("first_attempt_at", "last_attempt_at")})


def run_answers(answers: DataFrame, path: str, checkpoint: str) -> None:
    """``deliveries`` over what has arrived, appended to the table at ``path``; returns when it is written.

    State in processing time asks for one batch after another even without rows, so a run that ends has to go without those.
    """
    spark, name = answers.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name, "true")
    spark.conf.set(name, "false")
    try:
        query = answers.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
    query.awaitTermination()


# --- T3, J16: joins within a time bound -------------------------------------------------------------------------------


def answered_within(
    left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, minutes: int, watermark: str = WATERMARK, *, outer: bool = True
) -> DataFrame:
    """Rows of ``left`` with those of ``right`` of the same key at most ``minutes`` later; without one, with nulls, once, when the bound has passed.

    Both sides may be streams (append mode): rows wait in the join's state until both watermarks have passed their bound. Columns of
    ``right`` but the key must have names of their own.
    """
    if left.isStreaming:
        left, right = left.withWatermark(left_at, watermark), right.withWatermark(right_at, watermark)
    right = right.withColumnRenamed(key, "_right_key")
    within = (F.col(key) == F.col("_right_key")) & (F.col(right_at) >= F.col(left_at)) & (F.col(right_at) <= F.col(left_at) + F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return left.join(right, within, "leftOuter" if outer else "inner").drop("_right_key")


def unanswered(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, minutes: int, watermark: str = WATERMARK) -> DataFrame:
    """Rows of ``left`` that nothing of ``right`` follows within ``minutes``, each once."""
    return answered_within(left, right, key, left_at, right_at, minutes, watermark).where(F.col(right_at).isNull()).select(*left.columns)
