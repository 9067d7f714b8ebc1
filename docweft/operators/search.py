"""Keyword search."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import folded

WORD = re.compile(r"[^\W_]+|_+")


def query_tokens(query: str) -> list[str]:
    """Words of a query longer than one character, repeats kept; combining marks belong to their word."""
    plain = " ".join(query.split()).lower().replace("ß", "ss")
    words, at = [], ""
    import unicodedata

    for ch in plain + " ":
        if ch == "_" or unicodedata.category(ch)[0] in "LMN":
            at += ch
        else:
            words.append(at)
            at = ""
    return [w for w in words if len(w) > 1]


def token_vector(c: Column) -> Column:
    """distinct lower-case tokens, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}_]+)"), 1)))


def search_score(text: Column, query: str) -> Column:
    """share of the query's tokens that the folded text contains, rounded to 4 places; 0 without tokens."""
    tokens = query_tokens(query)
    if not tokens:
        return F.lit(0.0)
    hits = sum((text.contains(t).cast("int") for t in tokens), F.lit(0))
    return F.round(hits / F.lit(float(len(tokens))), 4)


def search(docs: DataFrame, query: str, *, text: Column, filters: Mapping[str, str | None] | None = None, limit: int = 20, id_col: str = "id") -> DataFrame:
    """The best ``limit`` rows with a score above 0 among those that equal the filters after folding.

    The tokens are literals of one scan; order is by score, then by the id as text.
    """
    out = docs
    for name, value in (filters or {}).items():
        if value is not None:
            out = out.where(folded(F.col(name)) == folded(F.lit(value)))
    out = out.withColumn("score", search_score(text, query)).where("score > 0")
    return out.orderBy(F.desc("score"), F.col(id_col).cast("string")).limit(limit)


class SearchBackend:
    """What other search implementations provide."""

    def search(self, docs: DataFrame, query: str, filters: Mapping[str, str | None] | None = None, limit: int = 20) -> DataFrame:
        return search(docs, query, text=F.col("search_text"), filters=filters, limit=limit)
