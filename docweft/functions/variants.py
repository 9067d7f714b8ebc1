"""Json as VARIANT columns (F43, F44, P13): parsed once, read by typed paths, malformed texts kept apart."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.extract import present

OBJECT = "map<string,variant>"


def parsed(rows: DataFrame, json_col: str, into: str = "value", error: str = "json_error") -> DataFrame:
    """``rows`` with the variant ``into`` and ``error``: ``missing`` for a null text, ``malformed`` for one that is no json, else null.

    The text is parsed in one projection; what follows reads the variant.
    """
    out = rows.withColumn(into, F.try_parse_json(json_col))
    reason = F.when(F.col(json_col).isNull(), "missing").when(F.col(into).isNull(), "malformed")
    return out.withColumn(error, reason)


def first_value(value: Column, paths: Sequence[str], kind: str = "string") -> Column:
    """the first path that has a value of the kind; an empty text is none. A value that cannot be of the kind is passed over."""
    found = [F.try_variant_get(value, p, kind) for p in paths]
    return F.coalesce(*[present(x) for x in found] if kind == "string" else found)


def fields(value: Column) -> Column:
    """An object's fields as a map of variants; null for any other value."""
    return F.try_variant_get(value, "$", OBJECT)


def merged_object(base: Column, changes: Column, without: Sequence[str] = ()) -> Column:
    """fields of ``changes`` win, those of ``without`` go, both as variants; what is no object counts as empty. Nested values stay whole."""
    none = F.from_json(F.lit("{}"), OBJECT)
    base, changes = F.coalesce(fields(base), none), F.coalesce(fields(changes), none)
    kept = F.map_filter(base, lambda k, v: ~k.isin(*without) & ~F.map_contains_key(changes, k)) if without else F.map_filter(base, lambda k, v: ~F.map_contains_key(changes, k))
    return F.to_variant_object(F.map_concat(kept, changes))


def contract_violations(rows: DataFrame, json_col: str, contract: Mapping[str, tuple[str, bool, object]], into: str = "violations") -> DataFrame:
    """``rows`` with an array of ``rule:field`` that the json breaks, in the order of ``checks.contract_violations``, of one parse."""
    out = parsed(rows, json_col, "_value", "_error").withColumn("_fields", fields(F.col("_value")))
    keys, made = F.map_keys("_fields"), [F.when(F.col("_fields").isNull(), "not_json")]
    for field, (kind, required, limit) in contract.items():
        there, value = F.map_contains_key("_fields", field), F.try_element_at(F.col("_fields"), F.lit(field))
        found = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        if required:
            made.append(F.when(~there, f"required:{field}"))
        allowed = {
            "string": found == "STRING", "string?": found.isin("STRING", "VOID"), "enum": found == "STRING",
            "strings": found.isin("ARRAY<STRING>", "ARRAY<VOID>"), "number?": found.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|VOID)"),
            "integer?": found.isin("BIGINT", "VOID"), "boolean": found == "BOOLEAN",
        }[kind]
        made.append(F.when(there & ~allowed, f"type:{field}"))
        if isinstance(limit, list):
            made.append(F.when(there & allowed & ~F.try_variant_get(value, "$", "string").isin(*limit), f"enum:{field}"))
        elif limit is not None:
            made.append(F.when(there & (F.try_variant_get(value, "$", "double") < limit), f"minimum:{field}"))
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, contract))), lambda k: F.concat(F.lit("additional:"), k))
    broken = F.array_compact(F.concat(F.array(*made), F.coalesce(extra, F.array().cast("array<string>"))))
    return out.withColumn(into, broken).drop("_value", "_error", "_fields")
