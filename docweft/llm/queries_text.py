"""Queries of the operators that score single texts: toxicity, token counts, decontamination, quality, language."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docweft.llm import language_id, quality, toxicity
from docweft.llm.common import held_out, shared_dir, table, tuned
from docweft.llm.decontaminate import find_contamination
from docweft.llm.token_counts import count_tokens

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs, labels, out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out("doc_id", 5, 0)
    model = toxicity.fit(docs, labels.where(~out))
    return toxicity.score_toxicity(docs.select("doc_id", "text").withColumn("held_out", out), model, carry=["doc_id", "held_out"])


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from a cache of the benchmark's counts, which are looked up; every other distinct text is encoded once here."""
    tuned(spark)
    cache = f"{shared_dir(spark)}/docweft/token-cache-{uuid.uuid4().hex}"
    count_tokens(table(spark, sf_dir, "benchmark"), tokenizer=tokenizer_path(), cache=cache, id_col="item_id")
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path(), cache=cache)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark"), carry=["doc_id"])


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = rf"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item, least(13, len(w)) AS m, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM bw),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT rid, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hits AS (SELECT rid, item, p, dg.m FROM dg JOIN win ON dg.m = win.m AND array_to_string(w[p:p + dg.m - 1], ' ') = g),
hw AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM hits) GROUP BY rid),
it AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AND 20 * coalesce(hw.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs, labels, out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out("doc_id", 3, 1)
    model = quality.fit(docs, labels.where(~out))
    return quality.score_quality(docs.select("doc_id", "text").withColumn("held_out", out), model, carry=["doc_id", "held_out"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = language_id.fit(docs.where(~out))
    return language_id.identify(docs.select("doc_id", "text").withColumn("held_out", out), model, carry=["doc_id", "held_out"])


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op4_token_counts": op4_token_counts,
    "op5_decontaminate": op5_decontaminate,
    "op7_quality": op7_quality,
    "op8_language_id": op8_language_id,
}
SQL = {"op5_decontaminate": OP5_SQL}
