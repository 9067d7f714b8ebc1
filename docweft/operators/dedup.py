"""Identity: canonical copies, inserts, patches and supersession."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.operators.joins import stored, with_totals


def canonical_by_checksum(docs: DataFrame, *, key: str = "checksum", id_col: str = "id", at: str = "received_at") -> DataFrame:
    """Adds ``canonical_id`` (the first arrival of the same checksum, ties by id) and ``duplicate``.

    One aggregation by checksum, of which only checksums that repeat are joined back: broadcast if they are few, else the most
    frequent ones are (``with_totals``), so that a checksum of any frequency is spread. Columns are carried through that join: leave texts out.
    A row without checksum stands for itself.
    """
    first = F.min(F.struct(F.col(at), F.col(id_col)))[id_col]
    groups = docs.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("canonical_id"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    out = with_totals(docs, stored(groups, "checksum-groups"), key, "_rows").withColumn("canonical_id", F.coalesce("canonical_id", id_col))
    out = out.select(*docs.columns, "canonical_id")
    return out.withColumn("duplicate", ~F.col("canonical_id").eqNullSafe(F.col(id_col)))


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: Sequence[str], *, order: str) -> DataFrame:
    """Rows of ``incoming`` whose key is new; of several with one key the first by ``order``. Null keys never match."""
    one = incoming.groupBy(*keys).agg(F.min_by(F.struct(*incoming.columns), order).alias("r")).select("r.*")
    return one.join(target.select(*keys), list(keys), "left_anti").select(*incoming.columns)


def known_sources(incoming: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` that are registered already."""
    return incoming.join(target.select(*keys), list(keys), "left_semi")


def patch_by_key(target: DataFrame, patches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null fields of the (unique) patches replace the target's; rows without a patch stay."""
    fields = [c for c in patches.columns if c not in keys]
    renamed = patches.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fields])
    new = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in fields}
    return target.join(renamed, list(keys), "left").withColumns(new).select(*target.columns)


def supersede(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (``old_id``, ``new_id``) of two distinct published documents, the patches of both.

    ``id, publication_status, canonical_id, supersedes_id, version``: the old one becomes Superseded and points at the new one, whose version
    is one more. Other requests give no row.
    """
    state = docs.select("id", "publication_status", F.coalesce("version", F.lit(1)).alias("version"))
    old = state.select(F.col("id").alias("old_id"), F.col("publication_status").alias("old_status"), F.col("version").alias("old_version"))
    new = state.select(F.col("id").alias("new_id"), F.col("publication_status").alias("new_status"))
    ok = requests.where("old_id <> new_id").join(old, "old_id").join(new, "new_id")
    ok = ok.where("old_status = 'Published' AND new_status = 'Published'")
    none = F.lit(None).cast(state.schema["id"].dataType)
    both = F.array(
        F.struct(F.col("old_id").alias("id"), F.lit("Superseded").alias("publication_status"), F.col("new_id").alias("canonical_id"), none.alias("supersedes_id"), F.col("old_version").alias("version")),
        F.struct(F.col("new_id").alias("id"), F.lit("Published").alias("publication_status"), none.alias("canonical_id"), F.col("old_id").alias("supersedes_id"), (F.col("old_version") + 1).alias("version")),
    )
    return ok.select(F.explode(both).alias("p")).select("p.*")
