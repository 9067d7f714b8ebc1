"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import checked_broadcast, stored, with_totals


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 64,
    digest_all: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    1. One scan gives every row's normalised length and prefix hash; lengths that occur once are done.
    2. Among the rest, (length, prefix hash) pairs that occur once are done.
    3. Only rows of the surviving pairs have their full text hashed (SHA-256) and grouped by it.

    Groups are counted by partial aggregation before any shuffle, so a group of any size costs one row
    for each task; rows meet their group's totals in a join that is broadcast for small totals and for hot groups
    (``with_totals``). Text itself is never shuffled unless the surviving pairs are too many to broadcast.

    ``digest_all`` hashes the other rows too, only so that ``text_sha256`` is filled in for them
    (else it is null outside the groups).

    Null and empty texts are equal, texts count whole. The row with the smallest id of a group stays; a null id is never smaller
    than another, and of several rows with that id one stays, the first as the digests were written (rows that repeat an id
    count singly in ``group_size``). Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    text = normalised(F.col(text_col))
    shape = [F.length(text).alias("len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix")]
    sig = stored(docs.select(*shape), "dedup-signatures")

    def repeated(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key)

    lengths = checked_broadcast(stored(repeated(sig, "len"), "dedup-lengths"))
    pairs = stored(repeated(sig.join(lengths, "len", "left_semi"), "len", "prefix"), "dedup-prefixes")
    pairs = checked_broadcast(pairs.withColumn("open", F.lit(True)))

    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), *shape)
    rows = rows.join(pairs, ["len", "prefix"], "left")
    digest = F.unhex(F.sha2("text", 256))
    rows = rows.select("doc_id", "open", (digest if digest_all else F.when(F.col("open"), digest)).alias("digest"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "dedup-digests")  # written, so the numbers stay
    groups = (
        rows.where("open")
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")
    )
    groups = stored(groups, "dedup-groups")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return with_totals(rows, groups, "digest", "group_size").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
