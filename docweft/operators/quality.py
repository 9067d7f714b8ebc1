"""Text accuracy against expected texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.functions.text import once, strip

#: Texts of more characters are compared bit-parallel in Python, in tasks of their own, instead of by Spark's own function.
LONGEST = 5000
#: Symbols of the expected text in one block of ``edit_distance``.
BLOCK = 8192


def edit_distance(a: Sequence, b: Sequence, block: int = BLOCK) -> int:
    """Exact edit distance of two sequences of any length: Myers' bit vectors over blocks of ``block`` symbols of ``b``.

    Memory is the two sequences, one small number for each symbol of ``a`` and one block's bit masks.
    """
    if a == b:
        return 0
    if not a or not b:
        return max(len(a), len(b))
    # the horizontal differences that the row above a block hands down; above the first block each is +1
    down = [1] * len(a)
    for at in range(0, len(b), block):
        part = b[at : at + block]
        masks: dict = {}
        for i, x in enumerate(part):
            masks[x] = masks.get(x, 0) | 1 << i
        full, top = (1 << len(part)) - 1, len(part) - 1
        plus, minus = full, 0
        for j, x in enumerate(a):
            eq, came = masks.get(x, 0), down[j]
            vertical = eq | minus
            if came < 0:
                eq |= 1
            across = (((eq & plus) + plus) ^ plus) | eq
            up, less = minus | (full & ~(across | plus)), plus & across
            down[j] = (up >> top & 1) - (less >> top & 1)
            up, less = up << 1 & full | (came > 0), less << 1 & full | (came < 0)
            plus, minus = less | (full & ~(vertical | up)), up & vertical
    return len(b) + sum(down)


@F.pandas_udf(T.LongType())
def long_char_edits(actual: pd.Series, expected: pd.Series) -> pd.Series:
    """Edits by code point of pairs beyond ``LONGEST``; null where either is null."""
    return pd.Series([None if a is None or b is None else edit_distance(a, b) for a, b in zip(actual, expected, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def long_word_edits(actual: pd.Series, expected: pd.Series) -> pd.Series:
    """Edits by word of such pairs; null where either is null."""
    return pd.Series([None if a is None or b is None else edit_distance(a.split(), b.split()) for a, b in zip(actual, expected, strict=True)], dtype="Int64")


def words(c: Column) -> Column:
    """Words between white space of any kind."""
    return F.array_remove(F.split(c, r"[\t-\r\x1c-\x1f\x85\p{Z}]+"), "")


def word_edits(actual: Column, expected: Column) -> Column:
    """edits by word: each word that both texts have is one character, all others of a text are one more, and those strings are compared.

    A word of one text alone matches nothing, whichever it is, so the distance is that of the word lists. Null where either is null.
    """
    symbol = lambda place, other: F.when(place > 0, F.lpad(F.hex(place + 0x10001), 8, "0")).otherwise(f"{other:08x}")

    def coded(of: Column, common: Column, other: int) -> Column:
        each = F.transform(of, lambda w: once(F.array_position(common, w), lambda place: symbol(place, other)))
        return F.decode(F.unhex(F.array_join(each, "")), "UTF-32")

    # the words and those in common are worked out once a pair, not once a word
    both = F.struct(words(actual).alias("a"), words(expected).alias("b"))
    lists = once(both, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.array_intersect(x["a"], x["b"]).alias("common")))
    return once(lists, lambda x: F.levenshtein(coded(x["a"], x["common"], 0x10000), coded(x["b"], x["common"], 0x10001)).cast("long"))


def rate(edits: Column, length: Column) -> Column:
    """edits over the expected length; an empty expectation is met (0) by an empty text only."""
    return F.when(length == 0, F.when(edits == 0, 0.0).when(edits > 0, 1.0)).otherwise(edits / length)


def error_rates(pairs: DataFrame, *, longest: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """J13's pairs (``case_id, actual, expected``) with ``cer, wer, exact_match, skipped`` and, for pooled rates,
    ``char_edits, expected_chars, word_edits, expected_words``, after ``case_id`` and the columns to ``carry``.

    Rates are exact for texts of any length, by Spark's own functions up to ``LONGEST`` characters. Pairs with a longer text are dealt
    by hash (as many tasks as their bytes need, one if there are none). Only a caller that sets ``longest`` has pairs above it
    skipped: those have null rates and say so in ``skipped``.
    """
    most = F.greatest(F.length("actual"), F.length("expected"))  # of the text that is not null if one is
    is_long = F.coalesce(most > LONGEST, F.lit(False))
    fits = F.lit(True) if longest is None else (F.length("actual") <= longest) & (F.length("expected") <= longest)
    kept = ["case_id", *carry]

    def rated(rows: DataFrame, chars: Callable[[Column, Column], Column], by_word: Callable[[Column, Column], Column]) -> DataFrame:
        a, b = F.when(fits, F.col("actual")), F.when(fits, F.col("expected"))
        both = a.isNotNull() & b.isNotNull()
        made = rows.select(
            *kept,
            chars(a, b).cast("long").alias("char_edits"),
            F.when(both, F.length(b)).cast("long").alias("expected_chars"),
            by_word(a, b).alias("word_edits"),
            F.when(both, F.size(words(b))).cast("long").alias("expected_words"),
            (strip(F.col("actual")) == strip(F.col("expected"))).alias("exact_match"),
            F.when(~fits, F.lit(f"longer than {longest}")).alias("skipped"),
        )
        return made.select(
            *kept,
            rate(F.col("char_edits"), F.col("expected_chars")).alias("cer"),
            rate(F.col("word_edits"), F.col("expected_words")).alias("wer"),
            "exact_match", "skipped", "char_edits", "expected_chars", "word_edits", "expected_words",
        )

    long = pairs.where(is_long).select(*kept, "actual", "expected").repartition(F.xxhash64("case_id", "actual"))
    return rated(pairs.where(~is_long), F.levenshtein, word_edits).unionByName(rated(long, long_char_edits, long_word_edits))


def corpus_rates(rates: DataFrame, by: str) -> DataFrame:
    """Mean rates, pooled rates (all edits over all expected characters or words) and the share of exact matches."""
    return rates.groupBy(by).agg(
        F.count(F.lit(1)).alias("cases"), F.avg("cer").alias("mean_cer"), F.avg("wer").alias("mean_wer"),
        (F.sum("char_edits") / F.nullif(F.sum("expected_chars"), F.lit(0))).alias("pooled_cer"),
        (F.sum("word_edits") / F.nullif(F.sum("expected_words"), F.lit(0))).alias("pooled_wer"),
        F.avg(F.col("exact_match").cast("double")).alias("exact_share"),
    )
