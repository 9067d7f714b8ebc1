"""Where users plug in recognition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.operators.joins import checked_broadcast, stored

RECOGNISED = "key string, text string, engine string, confidence double, regions array<struct<id:string,bbox:array<int>,text:string,confidence:double>>"


def recognise(files: DataFrame, engine: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], *, key: str = "sha256") -> DataFrame:
    """Run a recogniser once for each distinct file (``id, key, content``), then join its results to all files.

    ``engine`` gets batches of ``key, content`` and yields rows of ``RECOGNISED``. The file with a key's smallest id stands for it; it is
    told by keys alone, so that contents stay where they are read while those fit a broadcast. Results of rows that repeat an id are united.
    """
    first = stored(files.groupBy(F.col(key).alias("_key")).agg(F.min("id").alias("_id")), "recognise-first")
    same = (F.col(key) == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    one = files.join(checked_broadcast(first), same, "left_semi").select(F.col(key).alias("key"), "content")
    made = one.mapInPandas(engine, RECOGNISED).dropDuplicates(["key"])
    return files.drop("content").join(made, F.col(key) == F.col("key"), "left").drop("key")
