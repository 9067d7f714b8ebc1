"""What a row costs and how rows are dealt, so that a larger table takes no more than its share."""

import glob
import random
import re

import pytest
from docweft.functions import extract as ex
from docweft.functions import fixed_values as fixed
from docweft.functions import text as tx
from docweft.operators import checks, layout, quality
from docweft.plans import file_queries, queries  # noqa: F401  registers its queries
from docweft.plans import model as m
from docweft.streaming import sinks
from pyspark.sql import Window
from pyspark.sql import functions as F


def plan(spark, *columns):
    rows = spark.createDataFrame([("x",)], "t string")
    return rows.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])._jdf.queryExecution().optimizedPlan().toString()


def test_script_fields_match_each_pattern_once(spark):
    text = plan(spark, ex.script_authority(F.col("t")), ex.script_subject(F.col("t")), ex.required_action(F.col("t")))
    assert [text.count(x) for x in (r"issued\s*by", r"[^\r\n]{5,500}", r"required\s*action")] == [1, 2, 1]


def test_intelligence_reads_a_text_once(spark):
    text = plan(spark, ex.document_intelligence(F.col("t"), offices={"east": ["East Office"], "west": ["West Office"]}))
    assert text.count("split(") == 1 and text.count("East Office") == 1


def test_authority_of_a_header_is_found_once(spark):
    assert plan(spark, ex.header_authority(F.split("t", "\n"), ["office of the"])).count("office of the") == 1


def test_labelled_values_are_found_once(spark):
    assert plan(spark, ex.deadline(F.col("t"))).count(r"last\s*date") == 1
    assert plan(spark, ex.reference_number(F.split("t", "\n"))).count("memo no") == 2  # whether a line has the label, and what follows it


def test_contract_parses_a_result_once(spark):
    text = plan(spark, checks.contract_violations(F.col("t"))).lower()
    assert text.count("parsejson") == 1


def test_words_of_a_pair_are_split_once(spark):
    assert plan(spark, quality.word_edits(F.col("t"), F.concat("t", F.lit("y")))).count("split(") == 2


def test_parts_are_dealt_whatever_their_row_groups(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("p_partkey"), *[F.concat(F.lit("n"), "id").alias(c) for c in ("p_name", "p_brand", "p_type")])
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    held = m.parts(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in held) == 1000


def test_parts_are_dealt_by_their_number(spark, tmp_path):
    rows = spark.range(300_000).select(F.col("id").alias("p_partkey"), *[F.lit("n").alias(c) for c in ("p_name", "p_brand", "p_type")])
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    held = [r["count"] for r in m.parts(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 300_000 and max(held) <= 51_000


def test_words_of_a_text_are_looked_for_without_case_once(spark):
    text = plan(spark, ex.priority(F.col("t")), ex.category(F.col("t")))
    assert text.count("(?iu)") == 0 and text.count("lower(") == 2


def test_lines_are_cleaned_without_patterns_of_their_own(spark):
    assert "lambdafunction(regexp_replace" not in plan(spark, tx.text_lines(F.col("t"), strip_signs=True))


SEPARATORS = [" ", "  ", ":", "-", "\u2013", "\t", "\n", "\n", "\r", "\r\n", "\x0b", "\f", "\u00a0", "\x85", "\u2028", "\u2029", "\x1c", "", "\u00df"]


def odd_texts(words, n=3000):
    rng = random.Random(5)
    pieces = [lambda: rng.choice(SEPARATORS), lambda: rng.choice(SEPARATORS), lambda: rng.choice(words)]
    return ["".join(rng.choice(pieces)() for _ in range(rng.randrange(16))) for _ in range(n)]


def test_lines_of_odd_texts(spark):
    texts = odd_texts(["a", "b c", "\u0935\u093f\u0937\u092f"])
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", tx.text_lines(F.col("t")).alias("a"), tx.text_lines(F.col("t"), strip_signs=True).alias("b"))
    for r in got.collect():
        for edge, lines in (("[ \u00a0]", r["a"]), ("[ :\u2013\u2014-]", r["b"])):
            each = [re.sub(r"\s+", " ", x, flags=re.ASCII) for x in re.split(r"\r\n|[\n\r]", r["t"])]
            each = [re.sub(rf"^{edge}+|{edge}+(?=[\x85\u2028\u2029]?\Z)", "", x) for x in each]
            assert lines == [x for x in each if x], ascii(r["t"])


def test_words_are_found_as_patterns_without_case_find_them(spark):
    cascade = [*fixed.CATEGORY_CASCADE, ("K|S", "letters"), (r"e{2}", "no plain pattern")]
    words = [w.replace(r"\s*", gap) for p, _ in fixed.CATEGORY_CASCADE for w in p.split("|") for gap in ("", " ", "\n")]
    words += ["B\u017fEB", "PENS\u0130ON", "pens\u0131on", "admi\u00dfion", "\u212a", "fee", "FEe", "x"]
    cases = [None, *words, *map(str.upper, words), *odd_texts(words, 1000)]
    by_pattern = F.coalesce(*[F.when(F.col("t").rlike("(?iu)" + p), F.lit(name)) for p, name in cascade], F.lit("Other"))
    urgent = F.when(F.col("t").rlike("(?iu)" + fixed.URGENT), "HIGH").otherwise("NORMAL")
    rows = spark.createDataFrame([(t,) for t in cases], "t string")
    got = rows.select("t", ex.category(F.col("t"), cascade).alias("c"), by_pattern.alias("want"), ex.priority(F.col("t")).alias("p"), urgent.alias("how")).collect()
    assert [ascii(r["t"]) for r in got if r["c"] != r["want"] or r["p"] != r["how"]] == []
    assert len({r["c"] for r in got}) == len(cascade) + 1


REGION = "doc_id int, page int, id int, x1 int, y1 int, x2 int, y2 int"


def by_windows(regions):
    """The reading order by windows and a join, as a check."""
    placed = layout.columns(regions).join(layout.lines(regions), ["doc_id", "page", "id"])
    by_page = Window.partitionBy("doc_id", "page")
    placed = placed.withColumn("one", F.max("line").over(by_page) == 0)
    by_column = (F.col("column_count") >= 2) & ~F.col("one")
    by_place = by_column | F.col("one")
    keys = [F.when(by_column, F.col("column")).otherwise(0), F.when(by_place, F.col("y1")).otherwise(F.col("line")), F.when(by_place, F.col("x1")).otherwise(F.col("place")), F.col("id")]
    return placed.withColumn("position", F.row_number().over(by_page.orderBy(*keys)) - 1)


def test_reading_places_are_those_of_rows(spark):
    rng, rows = random.Random(3), []
    for doc in range(300):
        for i in range(rng.randrange(1, 12)):
            x, y = rng.choice([10, 14, 120, 250, 400]) + rng.randrange(6), rng.randrange(rng.choice([8, 60, 200]))
            rows.append((doc % 150, doc // 150, i, None if rng.random() < 0.02 else x, y, x + rng.randrange(90), y + rng.randrange(25)))
    regions = spark.createDataFrame(rows, REGION)
    names = ["doc_id", "page", "id", "line", "place", "column", "column_count", "position"]
    want = by_windows(regions).select(*names)
    found = layout.reading_places(regions)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, want.collect())) and found.count() == len(rows)
    assert {r.column_count for r in want.select("column_count").collect()} >= {1, 2, 3}
    summaries = lambda d: sorted((r.doc_id, r.page, r.region_count, r.line_count, r.column_count, r.multi_column, r.reading_order) for r in d.collect())
    assert summaries(layout.page_summaries(regions)) == summaries(layout.layout_summary(layout.reading_order(regions)))


@pytest.mark.parametrize("name", ["layout_summaries", "page_lines", "shared_page_lines"])
def test_layouts_read_regions_once_and_join_nothing(spark, name):
    text = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text and text.count("Exchange") == 2


def test_late_rows_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "TASK_ROWS", 50, raising=False)
    rows = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    write = sinks.late_writer(spark, str(tmp_path), rows.schema, ["event_id"], "ts")
    write(rows.unionByName(rows).coalesce(1), 0)
    files = lambda name, batch: len(glob.glob(f"{tmp_path}/{name}/run=*/batch={batch}/*.parquet"))
    assert files("on_time", 0) >= 20
    # few new rows, one of them old: the keys known since then are dealt too
    late = spark.range(30).select((F.col("id") + 990).alias("event_id"), F.timestamp_seconds(F.when(F.col("id") == 29, 0).otherwise(F.col("id") + 990) * 60).alias("ts"))
    write(late, 1)
    found = sorted((r.event_id, r.late) for r in sinks.parted(spark, str(tmp_path), rows.schema).collect())
    assert found == [(i, i == 1019) for i in range(1020)] and files("on_time", 1) >= 4


def test_counts_of_a_layout_work_no_columns_out(spark):
    pages = layout.page_summaries(spark.createDataFrame([(1, 1, 1, 0, 0, 1, 1)], REGION))
    plan_of = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "reach" in plan_of(pages) and "reach" not in plan_of(pages.select("doc_id", "page", "region_count", "line_count"))
