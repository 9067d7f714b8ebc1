"""Roll-ups of regions and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions.extract import heading_kind

PAGE = ["doc_id", "page"]


def confidence_rollup(regions: DataFrame, by: list[str], *, low: float = 0.70) -> DataFrame:
    """A3, A5: regions, scored ones, mean and least confidence, low flag; confidence is never an approval."""
    mean = F.avg("confidence")
    return regions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("region_count"),
        F.count("confidence").alias("scored_count"),
        mean.alias("mean_confidence"),
        F.min("confidence").alias("least_confidence"),
        F.coalesce(mean < low, F.lit(False)).alias("low_confidence"),
        F.lit(False).alias("approval"),
    )


def page_summary(pages: DataFrame) -> DataFrame:
    """By document: pages, recognised and embedded ones, distinct engines, methods in page order, and the method label."""
    methods = F.transform(F.array_sort(F.collect_list(F.struct("page", "method"))), lambda p: p["method"])
    recognised = F.count_if(F.col("method").startswith("ocr:"))
    embedded = F.count_if(F.col("method") == "embedded-text")
    return pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        recognised.alias("recognised_pages"),
        embedded.alias("embedded_pages"),
        F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"),
        F.array_join(methods, ",").alias("methods"),
        (F.countDistinct("method") > 1).alias("mixed"),
        F.when((recognised > 0) & (embedded > 0), "mixed").when(recognised > 0, "ocr").otherwise("embedded").alias("method_label"),
    )


def document_text(pages: DataFrame) -> DataFrame:
    """Page texts in page order, joined by an empty line."""
    parts = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def structure_evidence(regions: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """By page: regions, headings, whether there is body text, and, with ``placed`` (regions in visual lines), the lines."""
    kind = heading_kind(F.col("text"))
    out = regions.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("region_count"), F.count_if(kind == "heading_signal").alias("headings"), F.bool_or(kind == "body").alias("has_body")
    )
    if placed is None:
        return out
    return out.join(placed.groupBy(*PAGE).agg((F.max("line") + 1).alias("line_count")), PAGE, "left")
