"""The data model over the given tables: documents, lifecycle, intake, audits, regions, definitions.

Columns that the tables lack are derived from their keys by plain arithmetic, the same in Spark and in SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators.publish import text_chars
from docweft.sources.io import dealt, shared_dir, spread  # noqa: F401



def fresh() -> str:
    """A name for a folder that no other run has."""
    return uuid.uuid4().hex


NOW = "2024-02-01 00:00:00"


#: Tables of long texts: worth spreading when they are small files.
TEXTS = {"documents", "pages", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as letters are made of, dealt: reading a letter costs far more than its row."""
    return dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels: an unlabelled row has unknown flags."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("useful"), (F.col("toxic") == 1).alias("sensitive"))
    docs = table(spark, sf_dir, "documents")  # what needs the text is worked out before the join, which need not carry it then
    docs = docs.withColumns({"checksum": F.sha2("text", 256), "text_chars": text_chars(F.col("text"))}).join(labels, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("source_app"),
        "lang",
        F.col("text").alias("full_text"),
        "checksum",
        "text_chars",
        "useful",
        "sensitive",
        F.when(F.col("doc_id") % 11 == 0, "Processing").otherwise("Completed").alias("processing_status"),
        F.when(F.col("doc_id") % 13 == 0, "Published").when(F.col("doc_id") % 17 == 0, F.lit(None)).otherwise("Unpublished").alias("publication_status"),
        F.when(F.col("doc_id") % 19 == 0, "").otherwise(F.concat(F.lit("b"), "doc_id")).alias("backup_id"),
        F.when(F.col("doc_id") % 23 == 0, " ").otherwise("embedded-text").alias("extraction_method"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id % 40000 as int), 0)").alias("received_at"),
    )


DOCUMENTS_SQL = """d AS (SELECT x.doc_id AS id, x.source AS source_app, x.lang, x.text AS full_text, sha256(x.text) AS checksum,
  quality = 1 AS useful, toxic = 1 AS sensitive,
  CASE WHEN x.doc_id % 11 = 0 THEN 'Processing' ELSE 'Completed' END AS processing_status,
  CASE WHEN x.doc_id % 13 = 0 THEN 'Published' WHEN x.doc_id % 17 = 0 THEN NULL ELSE 'Unpublished' END AS publication_status,
  CASE WHEN x.doc_id % 19 = 0 THEN '' ELSE 'b' || x.doc_id END AS backup_id, CASE WHEN x.doc_id % 23 = 0 THEN ' ' ELSE 'embedded-text' END AS extraction_method,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(x.doc_id % 40000 AS INT)) AS received_at
  FROM documents x LEFT JOIN labels USING (doc_id))"""


def lifecycle_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents in all states."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        key.alias("id"),
        F.when(key % 3 == 0, "bot").otherwise("portal").alias("source_app"),
        F.when(key % 5 == 0, "chat").otherwise("upload").alias("source_location"),
        F.when(key % 7 != 0, (key % 20000).cast("string")).alias("source_id"),
        F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "P", "Processing Failed").otherwise("Processing").alias("processing_status"),
        F.when(F.substring("o_orderpriority", 1, 1) == "1", "Published").when(F.substring("o_orderpriority", 1, 1) == "5", F.lit(None)).otherwise("Unpublished").alias("publication_status"),
        F.when(key % 4 == 0, F.lit(None)).otherwise(key % 2 == 1).alias("approved"),
        F.when(key % 6 == 1, "Delivered").alias("delivery_status"),
        F.when(key % 8 == 0, "legacy").otherwise("vision 2").alias("extraction_method"),
        F.when(key % 10 == 0, "").otherwise("text").alias("full_text"),
        F.when(key % 9 == 0, F.lit(None)).otherwise(F.concat(F.lit("b"), key)).alias("backup_id"),
        F.when(key % 12 == 1, "").otherwise("url").alias("public_url"),
        F.expr("timestamp_ntz'2024-02-01 00:00:00' - make_dt_interval(0, 0, cast(o_orderkey % 120 as int), 0)").alias("received_at"),
        F.when(key % 3 != 1, F.expr("timestamp_ntz'2024-02-01 00:00:00' - make_dt_interval(0, 0, cast(o_orderkey % 50 as int), 0)")).alias("updated_at"),
        F.col("o_orderdate"),
        ((key % 3 == 0) | (key % 5 == 0)).alias("canonical"),
    )


LIFECYCLE_SQL = """ld AS (SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'bot' ELSE 'portal' END AS source_app,
  CASE WHEN o_orderkey % 5 = 0 THEN 'chat' ELSE 'upload' END AS source_location,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 20000 AS VARCHAR) END AS source_id,
  CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Processing Failed' ELSE 'Processing' END AS processing_status,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'Published' WHEN '5' THEN NULL ELSE 'Unpublished' END AS publication_status,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 2 = 1 END AS approved,
  CASE WHEN o_orderkey % 6 = 1 THEN 'Delivered' END AS delivery_status,
  CASE WHEN o_orderkey % 8 = 0 THEN 'legacy' ELSE 'vision 2' END AS extraction_method,
  CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'text' END AS full_text,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 'b' || o_orderkey END AS backup_id,
  CASE WHEN o_orderkey % 12 = 1 THEN '' ELSE 'url' END AS public_url,
  TIMESTAMP '2024-02-01 00:00:00' - to_minutes(CAST(o_orderkey % 120 AS INT)) AS received_at,
  CASE WHEN o_orderkey % 3 <> 1 THEN TIMESTAMP '2024-02-01 00:00:00' - to_minutes(CAST(o_orderkey % 50 AS INT)) END AS updated_at,
  o_orderdate, (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS canonical FROM orders)"""


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intake messages."""
    e, key = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        key.cast("string").alias("id"),
        F.when(key % 4 != 0, (key * 2 % 20000).cast("string")).alias("message_id"),
        F.when(key % 6 != 0, F.concat(F.lit("f"), key)).alias("file_id"),
        F.when(key % 5 == 0, "Processing Failed").when(key % 5 == 1, "Received").when(key % 5 == 2, "Processing").otherwise("Processed").alias("status"),
        F.when(key % 3 == 0, F.lit(None)).otherwise("Stored").alias("storage_status"),
        F.when(key % 7 == 0, "AVAILABLE").when(key % 31 == 0, "Failed").alias("nested_storage_status"),
        F.when(key % 11 != 0, "bucket").alias("bucket"),
        F.when(key % 13 != 0, "path").alias("path"),
        F.when(key % 9 == 0, key * 3 % 15000).alias("document_id"),
        F.expr("timestamp_ntz'2024-02-01 00:00:00' - make_dt_interval(0, 0, cast(event_id % 60 as int), 0)").alias("received_at"),
    )


INTAKE_SQL = """i AS (SELECT CAST(event_id AS VARCHAR) AS id,
  CASE WHEN event_id % 4 <> 0 THEN CAST(event_id * 2 % 20000 AS VARCHAR) END AS message_id,
  CASE WHEN event_id % 6 <> 0 THEN 'f' || event_id END AS file_id,
  CASE event_id % 5 WHEN 0 THEN 'Processing Failed' WHEN 1 THEN 'Received' WHEN 2 THEN 'Processing' ELSE 'Processed' END AS status,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Stored' END AS storage_status,
  CASE WHEN event_id % 7 = 0 THEN 'AVAILABLE' WHEN event_id % 31 = 0 THEN 'Failed' END AS nested_storage_status,
  CASE WHEN event_id % 11 <> 0 THEN 'bucket' END AS bucket, CASE WHEN event_id % 13 <> 0 THEN 'path' END AS path,
  CASE WHEN event_id % 9 = 0 THEN event_id * 3 % 15000 END AS document_id,
  TIMESTAMP '2024-02-01 00:00:00' - to_minutes(CAST(event_id % 60 AS INT)) AS received_at FROM events)"""


def audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase events as delivery audits."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(
        F.col("user_id").alias("document_id"),
        F.concat(F.lit("c"), F.col("event_id") % 4).alias("chat_id"),
        F.lit("delivery").alias("operation"),
        F.when(F.col("event_id") % 3 == 0, "Failed").when(F.col("event_id") % 3 == 1, "Sent").alias("result"),
        "event_id", "ts",
    )


AUDITS_SQL = """a AS (SELECT user_id AS document_id, 'c' || (event_id % 4) AS chat_id, 'delivery' AS operation,
  CASE event_id % 3 WHEN 0 THEN 'Failed' WHEN 1 THEN 'Sent' END AS result, event_id, ts FROM events WHERE event_type = 'purchase')"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as regions of one page an order."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
    li = li.agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_discount")])
    x = F.when(F.col("l_linenumber") % 2 == 1, 10).otherwise(250) + F.col("l_partkey") % 20
    y = F.col("l_linenumber") * 25 + F.col("l_suppkey") % 9
    return li.select(
        F.col("l_orderkey").alias("doc_id"),
        F.lit(1).alias("page"),
        F.col("l_linenumber").alias("id"),
        x.cast("int").alias("x1"),
        y.cast("int").alias("y1"),
        (x + 60 + F.col("l_partkey") % 50).cast("int").alias("x2"),
        (y + 20).cast("int").alias("y2"),
        F.concat(F.lit("w"), "l_partkey").alias("text"),
        F.when(F.col("l_linenumber") % 5 != 0, F.round(1 - F.col("l_discount") * 5, 2)).alias("confidence"),
    )


def shared_line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of which two or three stand in a line, of different heights, at slightly different places, some right of a gap."""
    r = regions(spark, sf_dir)
    y = (F.col("id") - F.col("id") % 3) * 14 + F.col("y1") % 13
    return r.withColumns({"y1": y.cast("int"), "y2": (y + 8 + F.col("x1") % 17).cast("int"), "x1": (F.col("x1") + F.col("id") % 3 * 40).cast("int"), "x2": (F.col("x2") + F.col("id") % 3 * 40).cast("int")})


REGIONS_SQL = """r AS (SELECT l_orderkey AS doc_id, 1 AS page, l_linenumber AS id,
  CAST((CASE WHEN l_linenumber % 2 = 1 THEN 10 ELSE 250 END) + l_partkey % 20 AS INT) AS x1, CAST(l_linenumber * 25 + l_suppkey % 9 AS INT) AS y1,
  CAST((CASE WHEN l_linenumber % 2 = 1 THEN 10 ELSE 250 END) + l_partkey % 20 + 60 + l_partkey % 50 AS INT) AS x2,
  CAST(l_linenumber * 25 + l_suppkey % 9 + 20 AS INT) AS y2, 'w' || l_partkey AS text,
  CASE WHEN l_linenumber % 5 <> 0 THEN round(1 - l_discount * 5, 2) END AS confidence
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL))"""

SHARED_REGIONS_SQL = REGIONS_SQL.replace("r AS", "q AS", 1) + """, r AS (SELECT doc_id, page, id, CAST(x1 + id % 3 * 40 AS INT) AS x1, CAST((id - id % 3) * 14 + y1 % 13 AS INT) AS y1,
  CAST(x2 + id % 3 * 40 AS INT) AS x2, CAST((id - id % 3) * 14 + y1 % 13 + 8 + x1 % 17 AS INT) AS y2, text, confidence FROM q)"""
