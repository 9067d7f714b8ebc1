"""Queries of the operators that are DataFrame functions throughout: exact dedup and mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.common import table
from docweft.llm.exact_dedup import exact_dedup
from docweft.llm.mixing import mix

DOMAINS = ["web", "books", "code"]
WEIGHTS = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "fr": 2, "de": 2}}
TARGET_FRACTION = 0.8
MAX_EPOCHS = 3
SEED = 17


def source_domain(source: Column) -> Column:
    """The domain that a source's trailing number stands for; sources without a number belong to the last."""
    number = F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")).try_cast("int")
    return F.element_at(F.array(*map(F.lit, DOMAINS)), F.coalesce(number % 3, F.lit(2)) + 1)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
k AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept FROM d)
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM k
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(
        table(spark, sf_dir, "documents"),
        domain=source_domain(F.col("source")),
        weights=WEIGHTS,
        target_fraction=TARGET_FRACTION,
        max_epochs=MAX_EPOCHS,
        seed=SEED,
    )


def _fill_sql(out: str, nodes: str, parents: str) -> str:
    """SQL of one level: ``nodes`` has the parents' columns, name, w, cap and the parent's budget b."""
    by = f"PARTITION BY {parents}" if parents else ""
    before = f"({by} ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
{out}_a AS (SELECT *, least(b, CAST(sum(cap) OVER ({by}) AS BIGINT)) AS bb,
  CAST(coalesce(sum(cap) OVER {before}, 0) AS BIGINT) AS cb,
  CAST(sum(w) OVER ({by}) - coalesce(sum(w) OVER {before}, 0) AS BIGINT) AS wl FROM {nodes}),
{out}_b AS (SELECT *, cap * wl <= (bb - cb) * w AS f FROM {out}_a),
{out}_c AS (SELECT *, CAST(coalesce(sum(CASE WHEN f THEN cap END) OVER ({by}), 0) AS BIGINT) AS sat,
  CAST(sum(CASE WHEN NOT f THEN w END) OVER ({by}) AS BIGINT) AS wo FROM {out}_b),
{out} AS (SELECT * EXCLUDE (bb, cb, wl, f, sat, wo, b), CASE WHEN f THEN cap ELSE ((bb - sat) * w) // wo END AS budget FROM {out}_c)"""


OP2_SQL = (
    rf"""
WITH d AS (SELECT doc_id,
  CASE coalesce(TRY_CAST(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT) % 3, 2)
    WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'code' END AS domain,
  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
r AS (SELECT * FROM d WHERE n_tokens > 0),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM r GROUP BY ALL),
n1 AS (SELECT domain, domain AS name, CAST(CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS BIGINT) AS w,
  CAST(sum(supply) * {MAX_EPOCHS} AS BIGINT) AS cap,
  (SELECT CAST(floor(CAST(sum(supply) AS DOUBLE) * CAST({TARGET_FRACTION} AS DOUBLE)) AS BIGINT) FROM leaf) AS b
  FROM leaf GROUP BY domain),"""
    + _fill_sql("f1", "n1", "")
    + rf""",
n2 AS (SELECT l.domain, l.lang, l.lang AS name, CAST(CASE l.lang WHEN 'en' THEN 6 WHEN 'fr' THEN 2 WHEN 'de' THEN 2 ELSE 1 END AS BIGINT) AS w,
  CAST(sum(supply) * {MAX_EPOCHS} AS BIGINT) AS cap, f1.budget AS b
  FROM leaf l JOIN f1 ON l.domain = f1.domain GROUP BY l.domain, l.lang, f1.budget),"""
    + _fill_sql("f2", "n2", "domain")
    + rf""",
n3 AS (SELECT l.domain, l.lang, l.source, l.source AS name, CAST(1 AS BIGINT) AS w, supply,
  supply * {MAX_EPOCHS} AS cap, f2.budget AS b
  FROM leaf l JOIN f2 ON l.domain = f2.domain AND l.lang = f2.lang),"""
    + _fill_sql("f3", "n3", "domain, lang")
    + rf""",
plan AS (SELECT domain, lang, source, budget // supply AS whole, budget % supply AS rest FROM f3),
p AS (SELECT r.*, whole, rest, md5('{SEED}:' || (whole + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM r JOIN plan USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS upto FROM p),
e AS (SELECT *, unnest(range(1, CAST(whole + CASE WHEN rest > 0 AND upto <= rest THEN 2 ELSE 1 END AS BIGINT))) AS epoch FROM c)
SELECT doc_id, domain, lang, source, CAST(epoch AS INT) AS epoch, n_tokens FROM e
"""
)

QUERIES = {"op2_mix_sources": op2_mix_sources, "op10_exact_dedup": op10_exact_dedup}
SQL = {"op2_mix_sources": OP2_SQL, "op10_exact_dedup": OP10_SQL}
