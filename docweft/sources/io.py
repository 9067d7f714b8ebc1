"""Sources and sinks."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.files import digest, file_format

CASE = "case_id string, source string, expected_text string, notes string"


def scan(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Some columns and rows of a parquet table; both reach the scan."""
    rows = spark.read.parquet(path)
    return (rows if where is None else rows.where(where)).select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local session may go without and gets a fresh one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(at)
    return at


#: Bytes of files up to which a scan may be dealt over more cores than it has splits.
SPREAD_BYTES = 256_000_000


def scan_bytes(rows: DataFrame) -> int:
    """Bytes of the files of a scan, as the plan knows them."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` (a scan) dealt evenly over the cores when its files are small (``SPREAD_BYTES``) and it has fewer partitions than there
    are cores: a small table in one file is read by one task otherwise. At most 8 partitions are made of each; a larger table is
    read as it lies, whatever the number of cores, so that its text is not shuffled."""
    if scan_bytes(rows) > SPREAD_BYTES:
        return rows
    cores, parts = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows if parts >= cores else rows.repartition(min(cores, max(1, 8 * parts)))


#: Rows of one part where a scan's rows are dealt for their work (``dealt``).
DEALT_ROWS = 50_000


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (some narrow columns of a scan) in even parts, for work on each row that costs far more than reading it: one a core at
    least, more by rows, which a scan counts from its footers. A split without a row group of its own is empty, so the splits of a file
    say nothing about its tasks; nor do its bytes, which pack a million narrow rows in a few megabytes; and cores may join later."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // DEALT_ROWS)))


def file_inventory(files: DataFrame) -> DataFrame:
    """``path, size, sha256, format`` of rows of the ``binaryFile`` source."""
    return files.select("path", F.col("length").alias("size"), digest(F.col("content")).alias("sha256"), file_format(F.col("content"), F.col("path")).alias("format"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files as rows; the pattern prunes before reading."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_cases(spark: SparkSession, path: str, schema: str = CASE) -> DataFrame:
    """Json lines without blank and ``#`` lines; malformed ones have nulls."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    return lines.select(F.from_json("value", schema).alias("c")).select("c.*")


def append_events(events: DataFrame, path: str, at: str = "created_at") -> None:
    """Append to a log that is partitioned by day."""
    events.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Packs (``{kind: {key: [term, ...]}}``) as ``pack, kind, key, term``; lists and single terms are keys of themselves."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("pack"), "value")
    kinds = text.select("pack", F.explode(F.from_json("value", "map<string,string>")).alias("kind", "body"))
    by_key = kinds.where(F.ltrim("body").startswith("{")).select("pack", "kind", F.explode(F.from_json("body", "map<string,string>")).alias("key", "terms"))
    listed = by_key.where(F.ltrim("terms").startswith("[")).select("pack", "kind", "key", F.explode(F.from_json("terms", "array<string>")).alias("term"))
    single = by_key.where(~F.ltrim("terms").startswith("[")).select("pack", "kind", "key", F.col("terms").alias("term"))
    plain = kinds.where(F.ltrim("body").startswith("[")).select("pack", "kind", F.explode(F.from_json("body", "array<string>")).alias("term"))
    return listed.unionByName(single).unionByName(plain.withColumn("key", F.col("term")))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """``{profile: {field: value}}`` as ``entity, profile_type, field_key, value``; the entity is the file's name."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("entity"), "value")
    fields = text.select("entity", F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("profile_type", "fields"))
    return fields.select("entity", "profile_type", F.explode("fields").alias("field_key", "value"))


def write_json(rows: DataFrame, path: str) -> None:
    """S10."""
    rows.write.mode("overwrite").json(path)
