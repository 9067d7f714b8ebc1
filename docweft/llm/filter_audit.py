"""How filters interact: what each would remove in every order, from counts of rows by the set of filters that they fail.

A text's repeats are found behind a counting Bloom prepass: sketches of all texts are merged, and only rows whose cells are all
met more than once are shuffled.
"""

from __future__ import annotations

import functools
import itertools
import json
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import checked_broadcast, stored, with_totals

#: Cells of a block of the sketch (a power of two), cells for each row, and cells that a text counts in.
BLOCK_BITS, CELLS_PER_ROW, HASHES = 18, 8, 3
#: Rows of a task that are counted at once.
SKETCH_ROWS = 1_000_000
SKETCH = "block long, cells binary, n_rows long"
MERGED = "block long, words array<long>, n_rows long"


def sketched(blocks: int) -> dict[str, Column]:
    """Block and cells of each row's ``h``."""
    again, mask = F.xxhash64("h", F.lit(1)), 2**BLOCK_BITS - 1
    cells = {f"cell{i}": F.shiftrightunsigned(again, i * BLOCK_BITS).bitwiseAND(F.lit(mask)).cast("int") for i in range(HASHES)}
    return {"block": F.pmod("h", F.lit(blocks).cast("long"))} | cells


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counting Bloom sketches of a task's rows, a row for each block: cell numbers times two, plus one where the count is above one."""
    fields = pa.schema([("block", pa.int64()), ("cells", pa.binary()), ("n_rows", pa.int64())])

    def sketch(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        cells, counts = np.unique((rows[:, :1] << BLOCK_BITS) + rows[:, 1:], return_counts=True)
        block, coded = cells >> BLOCK_BITS, ((cells & (2**BLOCK_BITS - 1)) * 2 + (counts > 1)).astype("<u4")
        names, begins = np.unique(block, return_index=True)
        per = dict(zip(*np.unique(rows[:, 0], return_counts=True), strict=True))
        parts = [x.tobytes() for x in np.split(coded, begins[1:])]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(parts, pa.binary()), pa.array([int(per[b]) for b in names])], schema=fields)

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        if sum(map(len, held)) >= SKETCH_ROWS:
            yield sketch(held)
            held = []
    if sum(map(len, held)):
        yield sketch(held)


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    """One block: counters of all tasks added up, two and more being alike, as a bit for each cell."""
    coded = np.concatenate([np.frombuffer(x, "<u4") for x in part["cells"]])
    counts = np.bincount(coded >> 1, weights=1 + (coded & 1), minlength=2**BLOCK_BITS)
    words = np.packbits(counts > 1, bitorder="little").view("<i8")
    return pd.DataFrame({"block": [part["block"].iloc[0]], "words": [words], "n_rows": [int(part["n_rows"].sum())]})


def possible_repeats(rows: DataFrame) -> DataFrame:
    """Rows of a stored table (with ``h``, a hash of the text) whose text may occur more than once; all others are unique for certain.

    The sketch has eight cells a row in blocks of 32 KB, so its size follows the table; a task ships only the cells that its rows
    count in. Rows meet their block in a broadcast join while all blocks together have at most ``BROADCAST_BYTES``, beyond it blocks
    with many rows (those of hot texts) stay broadcast and the others are joined by block.
    """
    blocks = max(1, math.ceil(rows.count() * CELLS_PER_ROW / 2**BLOCK_BITS))
    placed = rows.withColumns(sketched(blocks))
    cells = [f"cell{i}" for i in range(HASHES)]
    parts = placed.select("block", *cells).mapInArrow(_count, SKETCH)
    merged = stored(parts.groupBy("block").applyInPandas(_merge, MERGED), "audit-sketches")
    met = functools.reduce(Column.__and__, [F.expr(f"bit_get(words[{c} div 64], {c} % 64) = 1") for c in cells])
    return with_totals(placed, merged, "block", "n_rows", "inner").where(met).select(*rows.columns)


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    filters: Mapping[str, Column],
    repeats: str = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """What each filter removes at each step of each order of the filters, by part.

    ``filters`` has a letter and the failure condition (over the columns of ``docs``) of each filter; ``repeats`` is the letter of one
    more: a row fails it when a row with a smaller id has the same text. One row for each part, order and step:
    ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    1. One scan of the text gives each row's failures as bits, and the hash and SHA-256 of the text, which stand for it from there on.
    2. ``possible_repeats`` leaves the rows that may repeat; only these are grouped by full digest for their smallest id (partial
       aggregation first, so a text of any frequency costs one row a task).
    3. Rows are counted by part and bits; rows that fail ``repeats`` are taken from their count and added to the one with that bit.
       All results are sums over these at most 2 ** filters counts of a part.

    A null condition is no failure; null texts are empty, the null part is the empty string. A null id is never smaller than another
    and fails ``repeats`` never; rows that share an id are not each other's repeats. A document is good (toxic) if any row of ``labels``
    says so for its id. Other columns are ignored, texts count whole, an empty table gives no rows.
    """
    letters = [*filters, repeats]
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.coalesce(c, F.lit(False)).cast("int") * 2**i for i, c in enumerate(filters.values())]
    marks = labels.groupBy(F.col("doc_id")).agg(F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic"))
    marks = checked_broadcast(stored(marks.where("doc_id IS NOT NULL AND good + toxic > 0"), "audit-labels"))
    judged = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        sum(bits, F.lit(0)).alias("mask"),
        F.xxhash64(text).alias("h"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    judged = judged.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    rows = stored(judged, "audit-rows")

    possible = stored(possible_repeats(rows.where("doc_id IS NOT NULL")), "audit-possible")
    first = possible.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    again = with_totals(possible, stored(first, "audit-first"), "digest", "n_rows", "inner").where("doc_id > first_id")

    def counted(of: DataFrame) -> DataFrame:
        return of.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))

    moved = stored(counted(again), "audit-moved")
    less = moved.select("part", "mask", *[(-F.col(c)).alias(c) for c in ("n", "good", "toxic")])
    more = moved.withColumn("mask", F.col("mask") + 2 ** (len(letters) - 1))
    return order_effects(counted(rows).unionByName(less).unionByName(more), letters)


def order_effects(counts: DataFrame, letters: list[str]) -> DataFrame:
    """``filter_audit``'s result from ``part, mask, n, good, toxic``, where bit i of the mask is a failure of filter i; rows of one part
    and mask add up."""
    k, size = len(letters), 2 ** len(letters)
    free = [F.col("mask").bitwiseAND(F.lit(s)) == 0 for s in range(size)]
    sums = [F.array(*[F.sum(F.when(f, F.col(c)).otherwise(0)) for f in free]).alias(f"free_{c}") for c in ("n", "good", "toxic")]
    by_part = counts.groupBy("part").agg(*sums)

    def gone(column: str, earlier: Column, bit: Column) -> Column:
        """Rows that pass the filters of ``earlier`` and fail that of ``bit``."""
        return F.get(column, earlier) - F.get(column, earlier + bit)

    def over_orders(i: int) -> Column:
        """``removed`` of filter i, summed over all orders: a set of filters comes before it in so many of them."""
        sets = [s for s in range(size) if not s >> i & 1]
        ways = {s: math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) for s in sets}
        return sum((gone("free_n", F.lit(s), F.lit(1 << i)) * ways[s] for s in sets), F.lit(0))

    by_part = by_part.withColumn("sums", F.array(*[over_orders(i) for i in range(k)]))
    steps = []
    for order in itertools.permutations(range(k)):
        earlier = 0
        for step, i in enumerate(order, 1):
            steps.append({"filter_order": "".join(letters[j] for j in order), "step": step, "filter": i, "bit": 1 << i, "earlier": earlier})
            earlier |= 1 << i
    schema = "array<struct<filter_order:string,step:int,filter:int,bit:int,earlier:int>>"
    out = by_part.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(steps)), schema))).select("*", "s.*")
    earlier, bit, removed = F.col("earlier"), F.col("bit"), gone("free_n", F.col("earlier"), F.col("bit"))
    return out.select(
        "part",
        "filter_order",
        "step",
        F.get("free_n", earlier + bit).alias("kept"),
        removed.alias("removed"),
        (gone("free_n", F.lit(0), bit) - removed).alias("redundant"),
        gone("free_n", F.lit(size - 1) - bit, bit).alias("unique_fails"),
        gone("free_good", earlier, bit).alias("good_lost"),
        gone("free_toxic", earlier, bit).alias("toxic_lost"),
        F.get("sums", F.col("filter")).alias("shapley"),
    )
