"""Query of line dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweft.llm.common import table, tuned
from docweft.llm.line_dedup import line_digests, line_drops, with_bitmaps


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs = table(spark, sf_dir, "documents")
    return line_digests(with_bitmaps(docs, line_drops(docs, min_docs=10, min_chars=1)))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
g AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) AS kept, count(*) AS n FROM k WHERE key NOT IN (SELECT key FROM f) GROUP BY rid)
SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, len(ls) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""

QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {"op6_line_dedup": OP6_SQL}
