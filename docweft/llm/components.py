"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the undirected ``edges`` (``u, v``): root is the smallest node that it reaches.

    Each round points every node's larger neighbours to its smallest neighbour, then its smaller ones; the number of
    rounds grows with the logarithm of the longest path. Both steps are an aggregation by node and a join with it, so
    a node of any degree is pre-aggregated and its join can be split. Rounds are written tables; only
    two numbers a round come to the driver. Nulls and self loops are left out.
    """
    flat = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    flat = stored(flat.distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        flat = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = flat.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return flat.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        flat.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
