"""The index gives what the scan gives."""

import random

import pytest
from docweft.operators import search, search_index
from docweft.operators.publish import searchable
from pyspark.sql import functions as F


def corpus(n=400):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7))) for _ in range(150)] + ["Straße", "कार्यालय", "जिला", "x_y", "été", "OFFICE"]
    rows = [(i * 37 % 1009, rng.choice(["en", "DE ", None]), " ".join(rng.choice(words) + rng.choice(["", ",", "\n", "-"]) for _ in range(rng.randrange(0, 25)))) for i in range(n)]
    return rows + [(2000, "en", None), (2001, None, ""), (2002, "en", "!!")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame(corpus(), "id long, lang string, text string").repartition(5)
    at = str(tmp_path_factory.mktemp("index") / "i")
    return docs, search_index.IndexedSearch.build(docs, at, text=searchable([F.col("text")]), keep=["lang"])


@pytest.mark.parametrize("bits", [16, 3])
def test_index_equals_scan(spark, index, tmp_path, monkeypatch, bits):
    docs, whole = index
    if bits != 16:
        monkeypatch.setattr(search_index, "BLOCK_BITS", bits)
        whole = search_index.IndexedSearch.build(docs, str(tmp_path / "i"), text=searchable([F.col("text")]), keep=["lang"])
    queries = [("ab", None), ("ab cd ea", None), ("STRASSE office, जिला", {"lang": "EN"}), ("abc abc de", {"lang": "de", "x": None}), ("x_y b c", None), ("zzz", None), ("a !", None), ("été bcd zzzz", None)]
    for q, filters in queries:
        for limit in (3, 20):
            kept = {k: v for k, v in (filters or {}).items() if v is not None}
            want = [(r.id, r.score) for r in search.search(docs, q, text=searchable([F.col("text")]), filters=kept, limit=limit).collect()]
            got = whole.search(None, q, filters=filters, limit=limit).orderBy(F.desc("score"), F.col("id").cast("string")).collect()
            assert [(r.id, r.score) for r in got] == want, q
    assert whole.search(docs, "ab", limit=5).columns == ["id", "lang", "text", "score"]


def test_a_lookup_reads_its_own_words(index):
    _, whole = index
    assert {r.word for r in whole._matched(["stras"]).collect()} == {"strasse"}
    assert all("ab" in r.word for r in whole._matched(["ab"]).collect())
    assert whole._matched(["qqq"]).count() == 0


def test_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "id long, text string")
    made = search_index.IndexedSearch.build(docs, str(tmp_path / "i"), text=searchable([F.col("text")]))
    assert made.search(None, "any thing").count() == 0
