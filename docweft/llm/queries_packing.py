"""Query of token-id output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweft.llm.common import table, tuned
from docweft.llm.packing import pack
from docweft.llm.queries_text import tokenizer_path

ROW_TOKENS = 2048
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Free in this vocabulary; ends each document.
END_ID = 50256


def op9_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path(TOKENIZER), row_tokens=ROW_TOKENS, end_id=END_ID)


QUERIES = {"op9_pack_tokens": op9_pack_tokens}
