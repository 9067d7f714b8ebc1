"""Contracts as violation reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import once

REQUIRED_RESULT_KEYS = ["schema_version", "text", "normalized_text", "filename", "pages", "ocr"]

#: The closed contract of an extraction result: field -> (kind, required, allowed values or least number).
RESULT_CONTRACT: dict[str, tuple[str, bool, object]] = {
    "reference_number": ("string?", False, None), "issue_date_as_printed": ("string?", False, None),
    "issuing_authority": ("string?", False, None), "subject": ("string?", False, None),
    "short_description": ("string?", False, None), "detailed_summary": ("string?", False, None),
    "category": ("string", True, None), "priority": ("enum", True, ["URGENT", "HIGH", "NORMAL", "LOW", "IGNORE"]),
    "required_action": ("string", True, None), "deadline_as_printed": ("string?", False, None),
    "affected_entities": ("strings", False, None), "financial_amount": ("number?", False, None),
    "confidence": ("enum", True, ["HIGH", "MEDIUM", "LOW"]), "source_page": ("integer?", False, 1),
    "needs_manual_review": ("boolean", True, None),
}


def constraint_report(rows: DataFrame, rules: Mapping[str, Column], key: str = "id") -> DataFrame:
    """``id, rule`` of each rule that a row breaks (a null test passes, as constraints do); one pass."""
    broken = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.col(key), F.explode(broken).alias("rule"))


def release_gate(results: DataFrame, *, json_col: str = "result", required: Sequence[str] = REQUIRED_RESULT_KEYS) -> DataFrame:
    """Adds ``missing_keys, page_count, sequential_pages, valid`` to json results: all keys there, and pages numbered 1 to n."""
    keys = F.coalesce(F.json_object_keys(json_col), F.array().cast("array<string>"))
    pages = F.from_json(F.get_json_object(json_col, "$.pages"), "array<struct<page_number: int>>")
    numbers = F.transform(F.coalesce(pages, F.array().cast("array<struct<page_number: int>>")), lambda p: p["page_number"])
    missing = F.array_except(F.array(*map(F.lit, required)), keys)
    n = F.size(numbers)
    # sequence(1, n) counts down for n = 0, so the empty list is told apart first
    sequential = (n > 0) & (numbers == F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
    return results.withColumns(
        {
            "missing_keys": F.array_join(missing, ","),
            "page_count": n,
            "sequential_pages": F.coalesce(sequential, F.lit(False)),
            "valid": (F.size(missing) == 0) & F.coalesce(sequential, F.lit(False)),
        }
    )


def contract_violations(json_text: Column, contract: Mapping[str, tuple[str, bool, object]] = RESULT_CONTRACT) -> Column:
    """Array of ``rule:field`` that a json result breaks: required, type, enum, minimum, additional keys, or ``not_json``."""
    both = lambda j: F.struct(j.alias("text"), F.try_parse_json(j).alias("value"), F.json_object_keys(j).alias("keys"))
    return once(once(json_text, both), lambda x: _broken(x["text"], x["value"], x["keys"], contract))


def _broken(json_text: Column, value: Column, keys: Column, contract: Mapping[str, tuple[str, bool, object]]) -> Column:
    made = [F.when(value.isNull() | keys.isNull(), "not_json")]
    for field, (kind, required, limit) in contract.items():
        there = F.array_contains(keys, field)
        if required:
            made.append(F.when(~there, f"required:{field}"))
        found = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
        allowed = {
            "string": found == "STRING", "string?": found.isin("STRING", "VOID"), "enum": found == "STRING",
            "strings": found.isin("ARRAY<STRING>", "ARRAY<VOID>"), "number?": found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|VOID)"),
            "integer?": found.isin("BIGINT", "VOID"), "boolean": found == "BOOLEAN",
        }[kind]
        made.append(F.when(there & ~allowed, f"type:{field}"))
        if isinstance(limit, list):
            made.append(F.when(there & ~F.try_variant_get(value, f"$.{field}", "string").isin(*limit) & allowed, f"enum:{field}"))
        elif limit is not None:
            made.append(F.when(there & (F.get_json_object(json_text, f"$.{field}").try_cast("double") < limit), f"minimum:{field}"))
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, contract))), lambda k: F.concat(F.lit("additional:"), k))
    return F.array_compact(F.concat(F.array(*made), F.coalesce(extra, F.array().cast("array<string>"))))
