"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweft.llm.common import table, tuned
from docweft.llm.jaccard_join import jaccard_join


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return jaccard_join(table(spark, sf_dir, "documents"))


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}
