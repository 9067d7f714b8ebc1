"""Streams into tables: an append-only log (S5), and rows on time beside a table of late ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docweft.streaming.streams import WATERMARK


def append_log(stream: DataFrame, path: str, checkpoint: str, at: str = "created_at", keys: Sequence[str] = (), watermark: str = WATERMARK) -> StreamingQuery:
    """What has arrived, appended to a log of parquet files that is partitioned by ``day``; returns when all is written.

    The file sink commits whole micro-batches to its own log, which readers of the folder follow, so a batch that is run again after a
    failure leaves its rows once. With ``keys``, repeated events are dropped within the watermark too.
    """
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, watermark).dropDuplicatesWithinWatermark(list(keys)) if keys else stream
    out = rows.withColumn("day", F.to_date(at)).writeStream.format("parquet").outputMode("append").partitionBy("day")
    query = out.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _table(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    """All batches of one of the writer's tables; none yet: no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]))
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])).parquet(f"{path}/{name}")


#: Rows of a batch, and keys known before, that one task sorts to find keys that come twice.
TASK_ROWS = 250_000


def late_writer(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], at: str, delay_minutes: int = 60) -> Callable[[DataFrame, int], None]:
    """A writer for ``run_available`` that parts each batch into ``on_time`` and ``late`` rows, each key once in both together.

    A row is late when it is older than ``delay_minutes`` before the newest row of all batches before. That time is a table too
    (``newest``), so it outlives restarts and the query's checkpoint. Each batch has a folder of its own, named by the query
    and the batch's number, in each table: a repeated batch overwrites what it wrote and looks only at the others' rows. Known keys are looked up in
    rows from ``delay_minutes`` before the batch's oldest row on (the bound reaches the scan), so a resent row is known while its time
    is within that of the first. Rows with a null key part have no identity and are kept each time they come.

    A batch and the known keys are dealt by key into parts of about ``TASK_ROWS`` rows of both, so more rows make more tasks, not larger
    ones. All rows of one key meet in one part, as they must; its sort spills.
    """
    names = schema.fieldNames()

    def each(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        own = (F.col("run") == run) & (F.col("batch") == number)
        folder = f"run={run}/batch={number}"
        newest = _table(spark, path, "newest", T.StructType([T.StructField("at", schema[at].dataType)])).where(~own).agg(F.max("at")).first()[0]
        oldest, last, count = batch.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
        delay = F.make_dt_interval(mins=F.lit(delay_minutes))
        bound = F.lit(newest).cast(schema[at].dataType) - delay
        since = F.col(at) >= F.lit(oldest).cast(schema[at].dataType) - delay
        late = F.coalesce(F.col(at) < bound, F.lit(False))
        on_time, behind = (_table(spark, path, name, schema).where(~own & since).select(*keys) for name in ("on_time", "late"))
        known = on_time.unionByName(behind)
        parts = max(1, -(-(count + known.count()) // TASK_ROWS))
        known = known.repartition(parts, *keys)
        keyed = batch.select(*names).repartition(parts, *keys).dropDuplicates(list(keys))
        for name, rows in (("on_time", keyed.where(~late)), ("late", keyed.where(late))):
            rows.join(known, list(keys), "left_anti").select(*names).write.mode("overwrite").parquet(f"{path}/{name}/{folder}")
        top = max((x for x in (newest, last) if x is not None), default=None)
        row = spark.range(1).select(F.lit(top).cast(schema[at].dataType).alias("at"))
        row.write.mode("overwrite").parquet(f"{path}/newest/{folder}")

    return each


def parted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``late_writer`` wrote, with the column ``late``."""
    both = [_table(spark, path, name, schema).select(*schema.fieldNames()).withColumn("late", F.lit(name == "late")) for name in ("on_time", "late")]
    return both[0].unionByName(both[1])
