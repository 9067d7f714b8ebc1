"""Mixing sources to target weights by hierarchical budgets. DataFrame functions only.

The tree is domain > language > source. Weights are propagated from the root: each node's budget is
shared among its children in proportion to their weights; a child that cannot use its share (its
capacity is its tokens times ``max_epochs``) takes what it can and the shortage goes to its siblings.
Only what all children together cannot use stays with the parent's siblings, because a parent never
gets more than its own capacity. Each leaf then takes whole epochs, and a token prefix of one more,
in an order that the seed, the epoch and the id fix.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.common import checked_broadcast, stored

LEVELS = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"


def word_tokens(text: Column) -> Column:
    """The measure of a text: its words between ASCII white space, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_of(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """The weight of a node by its name, 1 where none is given. Weights are positive whole numbers."""
    given = weights.get(level, {})
    if any(int(w) != w or w < 1 for w in given.values()):
        raise ValueError(f"weights of {level} must be positive whole numbers")
    out = F.lit(1)
    for name, w in given.items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def shared_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Give each of ``nodes`` (``weight``, ``cap``, its parent's ``budget``) its own ``budget``.

    Children in order of cap / weight: one whose cap is at most its share of what is left is full; the
    full ones come first in that order, so running sums find them without iteration.
    """
    by = Window.partitionBy(*parents)
    order = by.orderBy(F.col("cap") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    sums = nodes.withColumns(
        {
            "budget": F.least("budget", F.sum("cap").over(by)),
            "cap_before": F.coalesce(F.sum("cap").over(order), F.lit(0)),
            "weight_left": F.sum("weight").over(by) - F.coalesce(F.sum("weight").over(order), F.lit(0)),
        }
    )
    full = sums.withColumn(
        "full", F.col("cap") * F.col("weight_left") <= (F.col("budget") - F.col("cap_before")) * F.col("weight")
    )
    rest = full.withColumns(
        {
            "budget_left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)),
            "weight_open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(by),
        }
    )
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(budget_left * weight) div weight_open"))
    return rest.withColumn("budget", share).drop(
        "cap_before", "weight_left", "full", "budget_left", "weight_open", "cap", "weight"
    )


def leaf_budgets(
    leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], target_fraction: float, max_epochs: int
) -> DataFrame:
    """``leaves`` (domain, lang, source, supply) with ``budget``: tokens to take, over all epochs."""
    leaves = leaves.withColumn("cap", F.col("supply") * max_epochs)
    total = math.floor((leaves.agg(F.sum("supply")).first()[0] or 0) * target_fraction)
    level = leaves
    for depth, name in enumerate(LEVELS):
        parents = LEVELS[:depth]
        nodes = leaves.groupBy(*parents, name).agg(F.sum("cap").alias("cap"))
        nodes = nodes.join(level, parents) if parents else nodes.withColumn("budget", F.lit(total).cast("long"))
        level = shared_out(nodes.withColumn("weight", weight_of(name, weights)), parents or [F.lit(1)], name)
    return leaves.join(level, LEVELS).select(*LEVELS, "supply", "budget")


def mix(
    docs: DataFrame,
    *,
    domain: Column,
    weights: Mapping[str, Mapping[str, int]],
    target_fraction: float = 0.8,
    max_epochs: int = 3,
    seed: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    bucket_digits: int = 3,
    carry: list[str] | None = None,
) -> DataFrame:
    """Chosen rows, one for each epoch that takes them: ``doc_id, domain, lang, source, epoch, n_tokens``, then ``carry``.

    Epoch e of a leaf orders its rows by md5(seed:e:id). Buckets of that digest are summed first, so
    that only the one bucket in which a leaf's budget ends is ordered row by row; a leaf with a third
    of all rows costs its 16 ** ``bucket_digits`` bucket sums and one bucket's rows in one task.
    Leaf tables are broadcast after a check of their size; text is not shuffled otherwise either
    unless there are more leaves than that.

    The prefix of an epoch ends before the first row that would exceed the budget, so a leaf may stay
    short by less than one document. Rows without words are never chosen. Null domain, language or
    source is the node ``unknown``. Rows that repeat an id stand together in the order and are chosen
    or left together; a text counts whole, however long. An empty table gives no rows. Whole shares are rounded down. A carried column
    named like a result is left out.
    """
    named = [
        F.coalesce(domain, F.lit("unknown")).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("unknown")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("unknown")).alias("source"),
    ]
    result = ["doc_id", *LEVELS, "epoch", "n_tokens"]
    carry = [c for c in carry or [] if c not in result]
    # a first word is found sooner than all are counted, and the count is not made twice for the filter
    rows = docs.where(F.col(text_col).rlike(WORD)).select(
        F.col(id_col).alias("doc_id"), *named, word_tokens(F.col(text_col)).alias("n_tokens"), *[f"`{c}`" for c in carry]
    )
    slim = stored(rows.select("doc_id", *LEVELS, "n_tokens"), "mix-rows")
    leaves = stored(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), "mix-leaves")
    plan = leaf_budgets(leaves, weights, target_fraction, max_epochs).select(
        *LEVELS,
        F.expr("budget div supply").alias("whole"),
        (F.col("budget") % F.col("supply")).alias("rest"),
    )
    plan = stored(plan, "mix-plan")

    def placed(df: DataFrame, leaf_table: DataFrame) -> DataFrame:
        """Rows with their leaf's plan and their place in the epoch that is taken in part."""
        key = F.concat_ws(":", F.lit(seed), (F.col("whole") + 1), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
        return df.join(checked_broadcast(leaf_table), LEVELS).withColumn("place", F.md5(key))

    bucket = F.substring("place", 1, bucket_digits)
    part = placed(slim, plan.where("rest > 0")).withColumn("bucket", bucket)
    sums = part.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket"))
    cut = sums.withColumn("upto", upto).where("upto > rest")
    cut = cut.groupBy(*LEVELS).agg(
        F.min("bucket").alias("bucket"), F.min_by(F.col("upto") - F.col("n"), "bucket").alias("base")
    )
    cut = stored(cut, "mix-cuts")

    order = Window.partitionBy(*LEVELS).orderBy("place")  # equal places, so repeated ids, are summed together
    last = (
        part.join(checked_broadcast(cut), [*LEVELS, "bucket"])
        .withColumn("upto", F.col("base") + F.sum("n_tokens").over(order))
        .where("upto <= rest")
        .groupBy(*LEVELS)
        .agg(F.max("place").alias("last_place"))
    )
    ends = cut.join(last, LEVELS, "left").select(*LEVELS, F.col("bucket").alias("cut_bucket"), "last_place")
    plan = stored(plan.join(ends, LEVELS, "left"), "mix-ends")

    taken = (F.col("rest") > 0) & ((bucket < F.col("cut_bucket")) | (F.col("place") <= F.col("last_place")))
    epochs = F.sequence(F.lit(1), F.col("whole").cast("int") + F.when(taken, 1).otherwise(0))
    chosen = placed(rows if carry else slim, plan).where((F.col("whole") > 0) | taken)
    return chosen.withColumn("epoch", F.explode(epochs)).select(*result, *[f"`{c}`" for c in carry])
