"""Token counts with a digest cache: texts are encoded once per content and tokenizer version."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.common import checked_broadcast, map_texts, stored, with_totals
from docweft.llm.tokenizers import encoder_for

CACHE = "content binary, n_tokens long, tokenizer string"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file is another version."""
    with open(path, "rb") as f:  # the path is a parameter that every machine has, like the library itself
        return hashlib.sha256(f.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version, one row per content; none if nothing was stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], CACHE).select("content", "n_tokens")
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame,
    *,
    tokenizer: str,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    1. Every row gets the SHA-256 of its content (null counts as empty); no text moves.
    2. Of each distinct content one row, the one with the smallest id, stands for it unless the cache folder has its
       count for this tokenizer version. The other rows are told by id and digest, a narrow table that is
       broadcast if small and shuffled otherwise. Where several rows of a content have its smallest id (or none has an id), one
       of their texts is taken by an aggregation with a partial step, so that each content is encoded once whatever the ids.
    3. The misses are encoded and appended to the cache; all rows then join the counts by digest.

    A task that is run again appends nothing twice (the write commits as a whole); rows that two
    runs appended at once are united on reading. The cache is partitioned by tokenizer version, so only its own counts
    are read. Rows with null or repeated ids are counted like all others, whole texts however long; other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    content = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), content.alias("content"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    )
    rows = stored(rows, "token-digests")
    first = rows.groupBy("content").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = stored(first, "token-contents")
    known = read_cache(spark, cache, version)
    repeated = stored(first.where("n > 1"), "token-repeated")
    copies = with_totals(rows, repeated, "content", "n", "inner")
    again = copies.where("doc_id > first_id OR (doc_id IS NULL AND first_id IS NOT NULL)")
    twins = copies.where("doc_id <=> first_id").groupBy("content").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("content")
    twins = stored(twins, "token-twins")  # contents whose smallest id is on several rows
    held = stored(first.join(known, "content"), "token-known")  # contents, not rows: no copy is hot
    skipped = again.select("doc_id", "content").unionByName(with_totals(rows, held, "content", "n", "inner").select("doc_id", "content"))
    skipped = stored(skipped.distinct(), "token-skips")

    missing = docs.select(F.col(id_col).alias("doc_id"), content.alias("content"), F.col(text_col).alias("text")).alias("d")
    skips = checked_broadcast(skipped).alias("s")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.content") == F.col("s.content"))
    missing = missing.join(skips, same, "left_anti").select("d.content", "d.text")
    if not twins.isEmpty():
        alike = checked_broadcast(twins)
        several = missing.join(alike, "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))
        missing = missing.join(alike, "content", "left_anti").unionByName(several)

    def start():
        encoder = encoder_for(tokenizer)
        return lambda texts: [encoder.counts(texts)]

    counted = map_texts(missing, "text", ["content"], "n_tokens long", start)
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = stored(first.select("content", "n").join(read_cache(spark, cache, version), "content"), "token-counts")
    return with_totals(rows, counts, "content", "n", "inner").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
