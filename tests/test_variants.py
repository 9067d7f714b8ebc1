"""VARIANT forms give what the json text forms give, with one parse."""

from docweft.functions import messages, variants
from docweft.operators import checks
from pyspark.sql import functions as F

TEXTS = [
    None, "", "{broken", "[1]", "3", "null", "{}", '{"a": {"b": "x"}, "k": ""}', '{"a": {"b": null}, "k": 7}', '{"k": [1, "z"], "gone": true}', '{"a": {"c": 1.5}, "k": "é"}',
    '{"category":"c","priority":"HIGH","required_action":"r","confidence":"LOW","needs_manual_review":false}',
    '{"category":null,"priority":"SOON","required_action":3,"confidence":"LOW","needs_manual_review":"no","source_page":0,"financial_amount":"x","affected_entities":["a",1],"more":1}',
    '{"category":"c","priority":"HIGH","required_action":"r","confidence":"LOW","needs_manual_review":true,"source_page":2,"financial_amount":1.25,"affected_entities":[],"subject":null}',
]


def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, j string")


def test_fields_equal_the_text_form(spark):
    paths = ["$.a.b", "$.k"]
    out = variants.parsed(rows(spark), "j")
    out = out.select("id", "json_error", variants.first_value(F.col("value"), paths).alias("v"), messages.json_first(F.col("j"), paths).alias("t"), variants.first_value(F.col("value"), paths[1:], "int").alias("n"))
    got = {r.id: r for r in out.collect()}
    assert [got[i].json_error for i in range(4)] == ["missing", "malformed", "malformed", None]
    assert all(got[i].v == got[i].t for i in got if i > 2) and got[8].n == 7 and got[10].n is None
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1


def test_merge(spark):
    d = spark.createDataFrame([('{"a": {"x": [1]}, "b": 2, "gone": 1}', '{"b": {"y": null}, "c": "s"}'), ('{"a": 1}', None), (None, "[1]")], "base string, changes string")
    d = variants.parsed(variants.parsed(d, "base", "p", "e1"), "changes", "q", "e2")
    got = [r[0] for r in d.select(F.to_json(variants.merged_object(F.col("p"), F.col("q"), ["gone"]))).collect()]
    assert got == ['{"a":{"x":[1]},"b":{"y":null},"c":"s"}', '{"a":1}', "{}"]


def test_contract_equals_the_text_form(spark):
    d = rows(spark)
    want = {r.id: r.v for r in d.select("id", checks.contract_violations(F.col("j")).alias("v")).collect()}
    out = variants.contract_violations(d, "j", checks.RESULT_CONTRACT)
    got = {r.id: r.violations for r in out.collect()}
    for i in want:
        assert sorted(got[i]) == sorted(want[i]), (i, TEXTS[i], got[i], want[i])
    assert out.columns == ["id", "j", "violations"]
