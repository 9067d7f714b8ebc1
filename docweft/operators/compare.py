"""Field-level and inventory reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.messages import title
from docweft.functions.text import compact, folded

PROPOSED = ["MISSING_IN_PORTAL", "MINOR_VARIATION", "VALUE_DIFFERENT"]


def field_status(portal: Column, source: Column) -> Column:
    """(status, proposed): how a portal's value stands to the source's."""
    p, s = folded(portal), folded(source)
    status = (
        F.when((p == "") & (s == ""), "NOT_AVAILABLE")
        .when(p == "", "MISSING_IN_PORTAL")
        .when(s == "", "MISSING_IN_SOURCE")
        .when(p == s, "MATCH")
        .when(compact(portal) == compact(source), "MINOR_VARIATION")
        .otherwise("VALUE_DIFFERENT")
    )
    return F.struct(status.alias("status"), F.when(status.isin(*PROPOSED), source).when(status == "MATCH", portal).alias("proposed"))


def compare_profiles(portal: DataFrame, source: DataFrame, keys: Sequence[str] = ("entity", "profile_type", "field_key")) -> DataFrame:
    """Full outer join of long profiles (``value``) on the union of their keys."""
    left = portal.select(*keys, F.col("value").alias("portal_value"))
    right = source.select(*keys, F.col("value").alias("source_value"))
    both = left.join(right, list(keys), "full_outer").withColumn("_f", field_status(F.col("portal_value"), F.col("source_value")))
    return both.select(*keys, title(F.col(keys[-1])).alias("label"), "portal_value", "source_value", "_f.*")


def change_preview(compared: DataFrame) -> DataFrame:
    """P10: rows with something to propose."""
    return compared.where(F.col("status").isin(*PROPOSED) & (F.coalesce("proposed", F.lit("")) != ""))


def preferred_value(values: DataFrame, keys: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """for each key the first non-null value in order of sources."""
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    rows = values.where(F.col("value").isNotNull()).withColumn("_rank", rank).where("_rank > 0")
    return rows.groupBy(*keys).agg(F.min_by("value", "_rank").alias("value"), F.min_by("source", "_rank").alias("source"))


def reconcile_inventories(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """``key, verdict`` of two inventories (``key, size, sha256``)."""
    a = primary.select("key", F.col("size").alias("size_a"), F.col("sha256").alias("sha_a"), F.lit(True).alias("in_a"))
    b = backup.select("key", F.col("size").alias("size_b"), F.col("sha256").alias("sha_b"), F.lit(True).alias("in_b"))
    verdict = (
        F.when(F.col("in_a").isNull(), "MISSING_IN_PRIMARY")
        .when(F.col("in_b").isNull(), "MISSING_IN_BACKUP")
        .when(~F.col("size_a").eqNullSafe(F.col("size_b")), "SIZE_MISMATCH")
        .when(~F.col("sha_a").eqNullSafe(F.col("sha_b")), "HASH_MISMATCH")
        .otherwise("OK")
    )
    return a.join(b, "key", "full_outer").select("key", verdict.alias("verdict"))


def name_drift(docs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Files (``file_id``) whose name is not the document's display name, or its original name without one."""
    wanted = docs.select("file_id", F.coalesce(F.nullif("display_filename", F.lit("")), "original_filename").alias("wanted"))
    both = wanted.join(inventory.select("file_id", "name"), "file_id")
    return both.where(~F.col("wanted").eqNullSafe(F.col("name")))


def first_digest(*candidates: Column) -> Column:
    """The first of the candidates that is a SHA-256 in hex, in lower case."""
    return F.coalesce(*[F.when(c.rlike("^[0-9a-fA-F]{64}$"), F.lower(c)) for c in candidates])


def verify_checksum(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """``id, expected, actual, ok``; ``ok`` is null where no valid digest is expected."""
    return expected.join(actual, "id").select("id", "expected", "actual", (F.col("expected") == F.lower("actual")).alias("ok"))
