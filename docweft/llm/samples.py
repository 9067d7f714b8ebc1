"""Bounded samples of labelled rows, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import stored


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, per_label: int, *, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_label`` rows of each label (``doc_id, label, text``), those first in order of md5(id), and the
    number of labelled ids by label over all of ``labels``.

    An id stands for one row: with several labels it has the largest, with several texts the smallest in string order. Null
    ids and null labels teach nothing.
    """
    one = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .where(F.col("label").isin(0, 1))
    )
    counts = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.md5(F.col("doc_id").cast("string"))
    parts = [one.where(F.col("label") == y).orderBy(place, "doc_id").limit(per_label) for y in (0, 1)]
    chosen = stored(parts[0].unionByName(parts[1]), "labelled-sample")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # at most 2 x per_label rows are broadcast
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), counts
