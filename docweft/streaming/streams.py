"""Structured Streaming forms (T1-T9). The batch operators are the source of truth; these give the same rows over bounded input."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweft.operators import deliver

WATERMARK = "1 hour"


def read_bounded(spark: SparkSession, path: str, schema, files_per_trigger: int = 16, pattern: str | None = None) -> DataFrame:
    """A folder in bounded batches; the query's checkpoint makes it resumable."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def deduplicated(stream: DataFrame, keys: Sequence[str], at: str, watermark: str = WATERMARK) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark(list(keys))


def latest_status(stream: DataFrame, key: str, at: str, status: str, tie: str) -> DataFrame:
    """Each document's latest status so far (update or complete mode)."""
    order = F.struct(at, tie)
    return stream.groupBy(key).agg(F.max_by(status, order).alias("status"), F.max(at).alias("at"))


def window_counts(stream: DataFrame, at: str, status: str, length: str = "24 hours", watermark: str = WATERMARK) -> DataFrame:
    """Rows by window and status."""
    rows = stream.withWatermark(at, watermark) if stream.isStreaming else stream
    return rows.groupBy(F.window(at, length).alias("w"), F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "status", "n"
    )


def stalled(stream: DataFrame, key: str, at: str, status: str, tie: str, limits: dict[str, int], now) -> DataFrame:
    """Documents whose latest status is older than its limit in minutes at ``now``; run with ``availableNow``."""
    latest = latest_status(stream, key, at, status, tie)
    limit = F.lit(None).cast("int")
    for s, minutes in limits.items():
        limit = F.when(F.col("status") == s, F.lit(minutes)).otherwise(limit)
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 60e6
    return latest.withColumn("minutes", age).where(age > limit)


def new_keys_only(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """T1 beyond the watermark: rows whose key the written table does not have."""
    return batch.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti")


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what has arrived since the last run, batch by batch, and stop.

    ``each`` may see a batch twice after a failure, so its writes must be by key. The checkpoint resumes after the last whole batch.
    """
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def claim_writer(spark: SparkSession, state_path: str, now, lease_minutes: int = 10) -> Callable[[DataFrame, int], None]:
    """T4: a writer for ``run_available`` that claims each batch's (document_id, chat_id) once.

    The state is a folder of versions, one for each batch number, so a batch that is seen twice writes the same version from the
    one before it; the newest version is the state. Claimed rows are locked at ``now`` until the lease ends.
    """

    def each(batch: DataFrame, number: int) -> None:
        known = claims(spark, state_path, before=number)
        made = deliver.claim(known, batch, now, lease_minutes)
        claimed = made.where("claimed").select(
            "document_id", "chat_id", F.lit("pending").alias("status"), now.alias("locked_at"), "attempts", "first_attempt_at", "last_attempt_at"
        )
        rest = known.join(claimed.select("document_id", "chat_id"), ["document_id", "chat_id"], "left_anti")
        rest.unionByName(claimed).write.mode("overwrite").parquet(f"{state_path}/version={number}")

    return each


CLAIMS = "document_id long, chat_id string, status string, locked_at timestamp_ntz, attempts int, first_attempt_at timestamp_ntz, last_attempt_at timestamp_ntz"


def claims(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame:
    """T4: the newest state that ``claim_writer`` wrote (before a batch number); none yet: no rows."""
    if before == 0:
        return spark.createDataFrame([], CLAIMS)
    if before is not None:
        return spark.read.schema(CLAIMS).parquet(f"{state_path}/version={before - 1}")
    versions = spark.read.schema(CLAIMS + ", version int").parquet(state_path)
    return versions.join(F.broadcast(versions.agg(F.max("version").alias("version"))), "version").drop("version")  # one row


def reconciled(published: DataFrame, chats: DataFrame, audits: DataFrame, operation: str, path: str) -> DataFrame:
    """Work items that are due and not yet queued in the table at ``path``; run again, it appends nothing twice."""
    due = deliver.worklist(published, chats, audits, operation)
    spark = published.sparkSession
    queued = spark.read.schema("document_id long, chat_id string").parquet(path)
    due.join(queued, ["document_id", "chat_id"], "left_anti").write.mode("append").parquet(path)
    return spark.read.schema("document_id long, chat_id string").parquet(path)


def split_late(batch: DataFrame, at: str, newest, watermark_minutes: int = 60) -> tuple[DataFrame, DataFrame]:
    """Rows on time, and those older than the watermark behind ``newest`` (to a table of late events)."""
    limit = newest - F.expr(f"INTERVAL {int(watermark_minutes)} MINUTES")
    return batch.where(F.col(at) >= limit), batch.where(F.col(at) < limit)


def batch_bounds(batch: DataFrame, key: str) -> DataFrame:
    """First and last item of a batch, and its size."""
    return batch.agg(F.min(key).alias("first_item"), F.max(key).alias("last_item"), F.count(F.lit(1)).alias("items"))
