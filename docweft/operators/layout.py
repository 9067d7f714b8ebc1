"""Page layout from regions.

Regions: ``doc_id, page, id, x1, y1, x2, y2, text, confidence``. Everything is by page; line grouping and table anchors, whose greedy
order no window expresses, are folds over a page's sorted regions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.operators.pages import PAGE


def normalise_regions(raw: DataFrame) -> DataFrame:
    """regions from ``bbox`` arrays, rounded, with a default id; ``valid`` tells four ordered coordinates (callers route the rest)."""
    b = [F.round(F.try_element_at("bbox", F.lit(i))).cast("int") for i in range(1, 5)]
    out = raw.withColumns(dict(zip(("x1", "y1", "x2", "y2"), b, strict=True)))
    valid = (F.size("bbox") == 4) & (F.col("x2") >= F.col("x1")) & (F.col("y2") >= F.col("y1"))
    return out.withColumns({"valid": F.coalesce(valid, F.lit(False)), "text": F.coalesce("text", F.lit("")), "id": F.coalesce("id", F.concat(F.lit("region-"), F.col("position").cast("string")))})


def columns(regions: DataFrame, *, least_regions: int = 2, gap: int = 24) -> DataFrame:
    """Adds ``column`` (from 0): a new one begins where the left edge is ``gap`` or more right of all edges so far; columns of
    fewer than ``least_regions`` are none, and a page with fewer than two columns or four regions has one."""
    order = Window.partitionBy(*PAGE).orderBy("x1", "x2", "id")
    so_far = F.max("x2").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = regions.withColumn("_new", F.when(F.col("x1") - so_far >= gap, 1).otherwise(0))
    out = out.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    island, page = Window.partitionBy(*PAGE, "_island"), Window.partitionBy(*PAGE)
    out = out.withColumns({"_size": F.count(F.lit(1)).over(island), "_all": F.count(F.lit(1)).over(page)})
    kept = F.when(F.col("_size") >= least_regions, F.col("_island"))
    out = out.withColumn("_kept", kept)
    rank = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy(F.col("_kept").asc_nulls_last())) - 1
    out = out.withColumn("_rank", rank).withColumn("_n", F.max(F.when(F.col("_kept").isNotNull(), F.col("_rank") + 1)).over(page))
    several = (F.coalesce("_n", F.lit(0)) >= 2) & (F.col("_all") >= 2 * least_regions)
    # a region of no column is read with the first, as one that no column claims
    column = F.when(several, F.when(F.col("_kept").isNotNull(), F.col("_rank")).otherwise(0)).otherwise(0)
    out = out.withColumns({"column": column.cast("int"), "column_count": F.when(several, F.col("_n")).otherwise(1).cast("int")})
    return out.drop("_new", "_island", "_size", "_all", "_kept", "_rank", "_n")


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _region(r: Column, *own: Column) -> Column:
    """A region as lines are made of: its centre first; ``m`` is what a line keeps of it, ``x1, id`` and ``own``."""
    whole = {n: r[n].cast("int").alias(n) for n in ("x1", "y1", "y2")}
    height = F.greatest(F.lit(1), r["y2"] - r["y1"]).cast("int").alias("h")
    member = F.struct(whole["x1"], r["id"].alias("id"), *own).alias("m")
    return F.struct(((r["y1"] + r["y2"]) / 2).alias("c"), whole["x1"], r["id"].alias("id"), whole["y1"], whole["y2"], height, member)


def _lines_of(page: Column, key: str, own: str = "", *, tolerance: int) -> Column:
    """W4 of a page's regions (an array of ``_region``, with the types of ``id`` and of ``own`` fields): an array of lines."""
    kind = f"struct<c:double,x1:int,id:{key},y1:int,y2:int,h:int,members:array<struct<x1:int,id:{key}{own}>>>"
    none = F.array().cast(f"array<{kind}>")

    def first(r: Column) -> Column:
        return F.struct(r["x1"].alias("x1"), r["id"].alias("id"))

    def headed(r: Column, members: Column) -> Column:
        return F.struct(*[r[n].alias(n) for n in ("c", "x1", "id", "y1", "y2", "h")], members.alias("members"))

    def joined(lines: Column, r: Column) -> Column:
        def near(line: Column, i: Column) -> Column:
            shared = F.greatest(F.lit(0), F.least(line["y2"], r["y2"]) - F.greatest(line["y1"], r["y1"]))
            away = F.abs(line["c"] - r["c"])
            return F.when((away <= tolerance) | (shared * 2 >= F.least(line["h"], r["h"])), F.struct(away.alias("away"), i.alias("i")))

        def put(best: Column) -> Column:
            def line_with(line: Column, i: Column) -> Column:
                members = F.concat(line["members"], F.array(r["m"]))
                own_head = F.when(first(r) < first(line), headed(r, members)).otherwise(headed(line, members))
                return F.when(i == best["i"], own_head).otherwise(line)

            begun = F.concat(lines, F.array(headed(r, F.array(r["m"]))))
            return F.when(best.isNull(), begun).otherwise(F.transform(lines, line_with))

        return _bound(F.array_min(F.transform(lines, near)), put)

    folded = F.array_sort(F.aggregate(F.array_sort(page), none, joined))  # by centre and left edge of the head
    return F.transform(folded, lambda line: F.struct(F.array_sort(line["members"]).alias("members")))


def page_lines(regions: DataFrame, *, tolerance: int = 12) -> DataFrame:
    """W4 by page: ``doc_id, page, lines``: visual lines from top to bottom, each a struct with ``members`` (``x1, id``) from left to right.

    A page's regions are folded in order of their centres over an array of the lines so far, each known by its head, the leftmost of its
    regions. A region joins the nearest line whose head is within ``tolerance`` of its centre or overlaps it by half of the lower
    of both heights, else it begins a line; ties go to the line that began first.
    """
    key = regions.schema["id"].dataType.simpleString()
    pages = regions.groupBy(*PAGE).agg(F.collect_list(F.struct("x1", "id", "y1", "y2")).alias("regions"))
    return pages.select(*PAGE, _lines_of(F.transform("regions", lambda r: _region(r)), key, tolerance=tolerance).alias("lines"))


def lines(regions: DataFrame, *, tolerance: int = 12) -> DataFrame:
    """``doc_id, page, id, line, place``: regions in visual lines (both from 0), each joined to the nearest line whose leftmost region
    is within ``tolerance`` of its centre or overlaps it by half."""
    placed = page_lines(regions, tolerance=tolerance).select(*PAGE, F.posexplode("lines").alias("line", "l"))
    placed = placed.select(*PAGE, "line", F.posexplode("l.members").alias("place", "m"))
    return placed.select(*PAGE, F.col("m.id").alias("id"), "line", "place")


def _islands(page: Column, reach: str, *, least_regions: int, gap: int) -> Column:
    """W3 of a page's regions (an array in order of ``x1, x2, id``): ``starts``, the places where a column may begin, ``kept``, those
    of the columns, and ``several``. The same rule as ``columns``, which has it for rows."""
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast(reach).alias("reach"), F.array(F.lit(0)).alias("starts"))

    def seen(a: Column, r: Column) -> Column:
        starts = F.when(r["x1"] - a["reach"] >= gap, F.concat(a["starts"], F.array(a["n"]))).otherwise(a["starts"])
        return F.struct((a["n"] + 1).alias("n"), F.greatest(a["reach"], r["x2"]).alias("reach"), starts.alias("starts"))

    def judged(a: Column) -> Column:
        ends = F.concat(F.slice(a["starts"], F.lit(2), F.size(a["starts"])), F.array(a["n"]))
        kept = F.filter(a["starts"], lambda s, k: F.get(ends, k) - s >= least_regions)
        several = lambda k: (F.size(k) >= 2) & (a["n"] >= 2 * least_regions)
        return _bound(kept, lambda k: F.struct(a["starts"].alias("starts"), k.alias("kept"), several(k).alias("several")))

    return _bound(F.aggregate(page, none, seen), judged)


def reading_pages(regions: DataFrame, *, tolerance: int = 12, least_regions: int = 2, gap: int = 24) -> DataFrame:
    """W5 by page: ``doc_id, page, region_count, line_count, column_count, placed``: regions (``id, line, place, column``) in reading order.

    A page is collected once and all else is worked out on its array, so its regions are neither joined nor sorted with other pages'.
    """
    types = {n: regions.schema[n].dataType.simpleString() for n in ("id", "x1", "x2", "y1")}
    pages = regions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x1", "x2", "id", "y1", "y2"))).alias("regions"))

    def column(w: Column, i: Column) -> Column:
        mine = F.array_max(F.filter(w["starts"], lambda s: s <= i))
        in_order = _bound(mine, lambda m: F.when(F.array_contains(w["kept"], m), F.size(F.filter(w["kept"], lambda k: k < m))))
        # a region of no column is read with the first, as one that no column claims
        return F.when(w["several"], F.coalesce(in_order, F.lit(0))).otherwise(0)

    def places(lines: Column, w: Column) -> Column:
        one = F.size(lines) == 1
        by_column = w["several"] & ~one
        by_place = by_column | one

        def place(m: Column, line: Column, j: Column, at: Column) -> Column:
            order = (F.when(by_column, at).otherwise(0), F.when(by_place, m["top"]).otherwise(line), F.when(by_place, m["left"]).otherwise(j))
            return F.struct(*[c.alias(f"o{n}") for n, c in enumerate(order)], m["id"].alias("id"), line.alias("line"), j.alias("place"), at.alias("column"))

        def placed(m: Column, line: Column, j: Column) -> Column:
            return _bound(column(w, m["i"]), lambda at: place(m, line, j, at))

        return F.array_sort(F.flatten(F.transform(lines, lambda line, i: F.transform(line["members"], lambda m, j: placed(m, i, j)))))

    # lines know a region's place in the sorted page, not its column, so that who asks for lines alone works no columns out
    own = lambda r, i: (r["x1"].alias("left"), r["y1"].alias("top"), i.alias("i"))
    lines = _lines_of(F.transform("regions", lambda r, i: _region(r, *own(r, i))), types["id"], f",left:{types['x1']},top:{types['y1']},i:int", tolerance=tolerance)
    islands = _islands(F.col("regions"), types["x2"], least_regions=least_regions, gap=gap)
    pages = pages.select(*PAGE, F.size("regions").alias("region_count"), lines.alias("lines"), islands.alias("islands"))
    column_count = F.when(F.col("islands.several"), F.size("islands.kept")).otherwise(1)
    placed = _bound(F.struct("lines", "islands"), lambda x: places(x["lines"], x["islands"]))
    return pages.select(*PAGE, "region_count", F.size("lines").alias("line_count"), column_count.alias("column_count"), placed.alias("placed"))


def reading_places(regions: DataFrame, *, tolerance: int = 12) -> DataFrame:
    """``doc_id, page, id, line, place, column, column_count, position``: line by line, or column by column where there are two
    columns or more; a page of one line is read by its regions' places alone."""
    placed = reading_pages(regions, tolerance=tolerance).select(*PAGE, "column_count", F.posexplode("placed").alias("position", "p"))
    return placed.select(*PAGE, *[F.col(f"p.{n}").alias(n) for n in ("id", "line", "place", "column")], "column_count", "position")


def reading_order(regions: DataFrame, *, tolerance: int = 12) -> DataFrame:
    """Regions with all their columns and those of ``reading_places``."""
    return regions.join(reading_places(regions, tolerance=tolerance), [*PAGE, "id"])


def line_texts(regions: DataFrame, placed: DataFrame) -> DataFrame:
    """The text of each line: its regions' non-empty texts in order."""
    both = regions.where("text <> ''").join(placed, [*PAGE, "id"])
    parts = F.array_sort(F.collect_list(F.struct("place", "text")))
    return both.groupBy(*PAGE, "line").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def table_anchors(regions: DataFrame, *, tolerance: int = 12, least_rows: int = 2, width: int = 12) -> DataFrame:
    """``doc_id, page, column_index, x, support_rows``: left edges that ``least_rows`` lines share.

    Edges are taken line by line: one that is more than ``width`` from all that were taken before is an anchor; the lines
    with an edge within ``width`` of an anchor support it.
    """
    pages = page_lines(regions, tolerance=tolerance).select(*PAGE, F.transform("lines", lambda line: F.transform(line["members"], lambda x: x["x1"])).alias("edges"))
    near = lambda x, a: F.abs(x - a) <= width
    none = F.array().cast("array<int>")
    taken = F.aggregate(F.flatten("edges"), none, lambda t, x: F.when(F.exists(t, lambda a: near(x, a)), t).otherwise(F.concat(t, F.array(x))))
    pages = pages.select(*PAGE, "edges", F.array_sort(taken).alias("taken"))
    support = lambda a: F.size(F.filter("edges", lambda line: F.exists(line, lambda x: near(x, a))))
    counted = F.transform("taken", lambda a: F.struct(a.alias("x"), support(a).alias("support_rows")))
    kept = F.filter(counted, lambda a: (a["support_rows"] >= least_rows) & (F.size("edges") >= least_rows))
    out = pages.select(*PAGE, F.posexplode(kept).alias("column_index", "a"))
    return out.select(*PAGE, "column_index", "a.x", "a.support_rows")


def table_evidence(placed: DataFrame, anchors: DataFrame, *, least_rows: int = 2) -> DataFrame:
    """By page: lines, lines of two cells or more, repeated columns, and whether that may be a table."""
    rows = placed.groupBy(*PAGE, "line").agg(F.count(F.lit(1)).alias("cells"))
    rows = rows.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("line_count"), F.count_if(F.col("cells") >= 2).alias("candidate_rows"))
    n = anchors.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("repeated_columns"))
    out = rows.join(n, PAGE, "left").withColumn("repeated_columns", F.coalesce("repeated_columns", F.lit(0)))
    return out.withColumn("table_candidate", (F.col("repeated_columns") >= 2) & (F.col("line_count") >= least_rows))


def layout_summary(ordered: DataFrame) -> DataFrame:
    """By page: regions, lines, columns, whether there are several columns, and the ids in reading order."""
    parts = F.array_sort(F.collect_list(F.struct("position", "id")))
    return ordered.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("region_count"),
        F.countDistinct("line").alias("line_count"),
        F.max("column_count").alias("column_count"),
        (F.max("column_count") > 1).alias("multi_column"),
        F.array_join(F.transform(parts, lambda p: p["id"].cast("string")), ",").alias("reading_order"),
    )


def page_summaries(regions: DataFrame, *, tolerance: int = 12) -> DataFrame:
    """W9 of all regions: what ``layout_summary`` gives for their reading order, without placing each region in a row."""
    return reading_pages(regions, tolerance=tolerance).select(
        *PAGE,
        F.col("region_count").cast("long").alias("region_count"),
        F.col("line_count").cast("long").alias("line_count"),
        "column_count",
        (F.col("column_count") > 1).alias("multi_column"),
        F.array_join(F.transform("placed", lambda p: p["id"].cast("string")), ",").alias("reading_order"),
    )


def low_confidence(regions: DataFrame, *, below: float = 0.65) -> DataFrame:
    """Regions whose confidence is known and low."""
    return regions.where(F.col("confidence").try_cast("double") < below)


def review_contract(regions: DataFrame, *, below: float = 0.65) -> DataFrame:
    """By document: number of review candidates and their ids in order."""
    ids = F.array_sort(F.collect_list(F.col("id").cast("string")))
    return low_confidence(regions, below=below).groupBy("doc_id").agg(F.count(F.lit(1)).alias("candidate_count"), F.array_join(ids, ",").alias("candidates"))


def visual_marks(dark: Column, chromatic: Column, transition: Column) -> Column:
    """(signals, review) of page metrics; two signals or more ask for a review."""
    found = F.array_compact(
        F.array(
            F.when(dark >= 0.055, "dark-ink-evidence"),
            F.when(chromatic >= 0.012, "colored-ink-evidence"),
            F.when(transition >= 0.035, "high-local-contrast-evidence"),
        )
    )
    return F.struct(F.array_join(found, ",").alias("signals"), (F.size(found) >= 2).alias("review"))


def engine_choice(requested: Column, quality: Column, *, default: str, better: str, threshold: float = 0.35) -> Column:
    """(engine, reason, escalated, error): bad pages asked of the default engine go to the better one; a quality outside 0 to 1 is an error."""
    wrong = quality.isNotNull() & ~quality.between(0, 1)
    up = ~wrong & (quality < threshold) & (requested == default)
    up = F.coalesce(up, F.lit(False))
    return F.struct(
        F.when(up, better).otherwise(requested).alias("engine"),
        F.when(up, "low_quality").otherwise("policy").alias("reason"),
        up.alias("escalated"),
        F.when(wrong, "quality out of range").alias("error"),
    )


def page_route(text: Column, least: int = 80) -> Column:
    """Embedded text if it has enough signs that are no blanks, else recognition."""
    return F.when(F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")) >= least, "embedded-text").otherwise("recognise")
