"""Joins whose small side is broadcast only after its bytes were measured, and that keep hot keys apart."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.sources.io import shared_dir

#: Bytes that a table may have to be broadcast (``table_bytes``); beyond it the same join is shuffled.
BROADCAST_BYTES = 64_000_000
#: Rows from which on a group's totals are joined apart from the others, where that many groups can be broadcast.
HOT_ROWS = 10_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/docweft/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: 24 bytes, 8 a number, and the lengths of its strings and arrays."""
    size = F.lit(24)
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + 16 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            each = 8 * len(f.dataType.elementType.fields) + 24 if isinstance(f.dataType.elementType, T.StructType) else 8
            size = size + 16 + each * F.coalesce(F.size(f.name), F.lit(0))
        else:
            size = size + 8
    return size.cast("long")


def table_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(row_bytes(df))).first()[0] or 0


def checked_broadcast(small: DataFrame, limit: int | None = None) -> DataFrame:
    """``small`` (a stored table, so that measuring it is one short scan) with a broadcast hint if it has at most ``limit`` bytes
    (``BROADCAST_BYTES``).

    Beyond that the table comes back as it is and Spark shuffles the join.
    """
    return F.broadcast(small) if table_bytes(small) <= (BROADCAST_BYTES if limit is None else limit) else small


def hot_from(totals: DataFrame, size: str) -> int:
    """The least size, ``HOT_ROWS`` or that times a power of two, from which on all groups of that size can be broadcast: one scan."""
    level = F.greatest(F.lit(0), F.floor(F.log2(F.col(size) / HOT_ROWS))).cast("int")
    sizes = dict(totals.where(F.col(size) >= HOT_ROWS).groupBy(level.alias("level")).agg(F.sum(row_bytes(totals))).collect())  # a row a power of two
    held, least = 0, max(sizes, default=0) + 1
    while least - 1 in range(min(sizes, default=0), least) and held + sizes.get(least - 1, 0) <= BROADCAST_BYTES:
        least -= 1
        held += sizes.get(least, 0)
    return HOT_ROWS * 2**least if sizes else HOT_ROWS


def with_totals(rows: DataFrame, totals: DataFrame, key: str | list[str], size: str, how: str = "left") -> DataFrame:
    """``rows`` joined (``how``: left or inner) with ``totals``, a stored table of one row for each ``key`` with the group's ``size`` in rows.

    Rows whose key is null in part match nothing and are not shuffled; ``how`` left keeps them.
    Small totals are broadcast. Otherwise the largest groups are (all from a size on that makes them fit, ``hot_from``), so that no
    such group meets in one task, and only the other rows are shuffled.
    """
    if table_bytes(totals) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(totals), key, how)
    least = hot_from(totals, size)
    hot = F.broadcast(stored(totals.where(F.col(size) >= least), "hot-totals"))
    keyed = functools.reduce(Column.__and__, [F.col(c).isNotNull() for c in ([key] if isinstance(key, str) else key)])
    rest = rows.where(keyed).join(hot, key, "left_anti").join(totals.where(F.col(size) < least), key, how)
    out = rows.join(hot, key).unionByName(rest)
    return out.unionByName(rows.where(~keyed), allowMissingColumns=True) if how == "left" else out
