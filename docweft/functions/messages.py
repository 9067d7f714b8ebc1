"""Columns for messages, tags, stages and json."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions.extract import present
from docweft.functions.text import strip


def escaped(c: Column) -> Column:
    """single blanks, stripped, with ``& < >`` as entities."""
    c = strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def field_lines(fields: Sequence[tuple[str, Column]]) -> Column:
    """``label: value`` lines of the fields that have a value."""
    made = [F.when(present(escaped(v)).isNotNull(), F.concat(F.lit(f"{label}: "), escaped(v))) for label, v in fields]
    return F.array_join(F.array_compact(F.array(*made)), "\n")


def display_date(c: Column) -> Column:
    """dd-MM-yyyy."""
    return F.date_format(c, "dd-MM-yyyy")


def search_tags(category: Column, subject: Column, by_category: Mapping[str, Sequence[str]], most: int = 8) -> Column:
    """The category's tags, then the subject's longer words, distinct in order."""
    listed = F.lit(None).cast("array<string>")
    for name, tags in by_category.items():
        listed = F.when(category == name, F.array(*map(F.lit, tags))).otherwise(listed)
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce(subject, F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1), lambda w: F.length(w) >= 4)
    return F.slice(F.array_distinct(F.concat(F.coalesce(listed, F.array().cast("array<string>")), words)), 1, most)


def stage_text(status: Column, texts: Mapping[str, str]) -> Column:
    """(text, error): the text of a status; an unknown one is named in ``error``."""
    out = F.lit(None).cast("string")
    for name, text in texts.items():
        out = F.when(status == name, F.lit(text)).otherwise(out)
    return F.struct(out.alias("text"), F.when(out.isNull(), F.concat(F.lit("unknown status: "), F.coalesce(status, F.lit("null")))).alias("error"))


def json_first(c: Column, paths: Sequence[str]) -> Column:
    """the first path of a json text that has a value."""
    return F.coalesce(*[present(F.get_json_object(c, p)) for p in paths])


def merged_map(base: Column, changes: Column, without: Sequence[str]) -> Column:
    """keys of ``changes`` win; keys of ``without`` go. Null counts as empty."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    base, changes = F.coalesce(base, empty), F.coalesce(changes, empty)
    kept = F.map_filter(base, lambda k, v: ~k.isin(*without) & ~F.map_contains_key(changes, k)) if without else F.map_filter(base, lambda k, v: ~F.map_contains_key(changes, k))
    return F.map_concat(kept, changes)


def title(c: Column) -> Column:
    """a key as a label."""
    return F.initcap(F.translate(c, "_", " "))


def evidence(source: Column, page: Column, region: Column, field: Column) -> Column:
    """a map of what is known about where a value came from."""
    whole = F.create_map(F.lit("source"), source, F.lit("page"), page.cast("string"), F.lit("region_id"), region, F.lit("field"), field)
    return F.map_filter(whole, lambda k, v: v.isNotNull())
