"""Query of the Merkle manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm.common import table
from docweft.llm.merkle import leaf, merkle_manifest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lowered = F.when(chosen, leaf([*rest, F.translate("text", UPPER, LOWER)]))
    return merkle_manifest(docs, leaf=leaf([*rest, F.col("text")]), changed=lowered)


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _tree_sql(name: str, source: str, by: str, levels: int) -> str:
    """SQL of ``levels`` levels over ``source`` (by, i, node): tables name_0 to name_levels (by, i, node, n, lft, rgt); a level of one node stays."""
    run = f"PARTITION BY {by}, i // 8 ORDER BY i"
    out, before = [], source
    for level in range(levels + 1):
        out.append(f"""{name}_{level} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {by}) AS n,
  coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
  coalesce(string_agg(node, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM ({before}))""")
        now = f"{name}_{level}"
        before = (
            f"SELECT {by}, i // 8 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node FROM {now} WHERE n > 1 GROUP BY {by}, i // 8"
            f" UNION ALL SELECT {by}, i, node FROM {now} WHERE n = 1"
        )
    return ",\n".join(out)


#: Levels that the SQL spells out: 8 ** 7 leaves of a language, 8 ** 3 languages.
LEAF_LEVELS, TOP_LEVELS = 7, 3


def _path_sql() -> str:
    """Columns p (segments so far) and x (the folded node) through all levels."""
    steps, before = [], "s0"
    for level in range(LEAF_LEVELS + TOP_LEVELS):
        low = level < LEAF_LEVELS
        t = f"g_{level}" if low else f"h_{level - LEAF_LEVELS}"
        on = f"b.g = a.g AND b.i = a.i // {8**level}" if low else f"b.k = a.k AND b.i = a.hi // {8 ** (level - LEAF_LEVELS)}"
        if low:  # a group that has one node left stays there
            on = f"b.g = a.g AND b.i = CASE WHEN a.n > {8**level} THEN a.i // {8**level} ELSE 0 END"
        steps.append(f"""s{level + 1} AS MATERIALIZED (SELECT a.* EXCLUDE (p, x), CASE WHEN b.n > 1 THEN a.p || b.lft || b.rgt ELSE a.p END AS p,
  CASE WHEN b.n > 1 THEN sha256(b.lft || a.x || b.rgt) ELSE a.x END AS x FROM {before} a JOIN {t} b ON {on})""")
        before = f"s{level + 1}"
    return ",\n".join(steps)


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, 8 * len(CAST(doc_id AS VARCHAR))),
  lambda j: CASE WHEN j % 8 = 0 THEN CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(j // 8 + 1 AS BIGINT), 1)) AS BIGINT) ELSE 0 END)),
  lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""

OP12_SQL = f"""
WITH d AS (SELECT doc_id, lang, {_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} AS head, text,
  CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS changed FROM documents),
l AS MATERIALIZED (SELECT doc_id, coalesce('g' || lang, '') AS g, sha256(head || {_field('text')}) AS node, sha256(head || {_field('changed')}) AS x FROM d),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
{_tree_sql("g", "SELECT g, i, node FROM r", "g", LEAF_LEVELS)},
heads AS MATERIALIZED (SELECT 0 AS k, row_number() OVER (ORDER BY g) - 1 AS i, node, g FROM g_{LEAF_LEVELS}),
{_tree_sql("h", "SELECT k, i, node FROM heads", "k", TOP_LEVELS)},
s0 AS MATERIALIZED (SELECT r.doc_id, r.node AS leaf, r.g, r.i, r.n, heads.i AS hi, heads.k, heads.node AS subroot, '' AS p, r.x AS x
  FROM r JOIN heads USING (g)),
{_path_sql()}
SELECT doc_id, leaf, subroot, (SELECT node FROM h_{TOP_LEVELS}) AS root, sha256(p) AS proof_sha256, x AS folded_root,
  x = (SELECT node FROM h_{TOP_LEVELS}) AS verified FROM s{LEAF_LEVELS + TOP_LEVELS}
"""

QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
SQL = {"op12_merkle_manifest": OP12_SQL}
