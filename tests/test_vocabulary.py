"""A vocabulary table gives what the patterns of ``match_terms`` give."""

import random
import time


from docweft.operators import joins, vocab
from pyspark.sql import functions as F

WORDS = {
    "a": ["head office", "office", "Head"], "b": ["(x)", "x-y", "no."], "c": ["कार्यालय", "जिला शिक्षा"], "d": ["one two three four", "two  three", "TWO"], "e": ["über Straße", "_id", "a.b.c"],
}
TEXTS = [
    None, "", "  ", "Head office", "the HEAD  office of", "office", "offices officer", "x-y (x) no.", "a(x)", "(x)b", "(x)", "((x))", "no.1", "no. 1", "जिला शिक्षा कार्यालय", "कार्यालयों",
    "one two three four five", "one two  three", "ÜBER straße", "my_id _id", "a.b.c.d", "x a.b.c", "a..b.c", "two", "TWO three",
]


def both(spark, texts, words):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    table = spark.createDataFrame([(k, t) for k, terms in words.items() for t in terms], "key string, term string")
    want = {(r.id, m["key"]): m["term"] for r in docs.select("id", vocab.match_terms(F.col("text"), words).alias("m")).collect() for m in r.m or []}
    got = {(r.id, r.key): r.found for r in vocab.match_vocabulary(docs, table).collect()}
    resolved = sorted(map(str, docs.select("id", vocab.resolve(F.coalesce("text", F.lit("")), words).alias("r")).select("id", "r.*").collect()))
    return want, got, resolved, sorted(map(str, vocab.resolve_vocabulary(docs, table).collect()))


def test_table_equals_patterns(spark, monkeypatch):
    want, got, resolved, by_table = both(spark, TEXTS, WORDS)
    assert {k: (got.get(k), want.get(k)) for k in {**got, **want} if got.get(k) != want.get(k)} == {}
    assert len(want) > 10 and by_table == resolved
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    assert both(spark, TEXTS, WORDS)[1] == want


def test_random_texts(spark):
    rng = random.Random(11)
    parts = ["ab", "a", "b-c", "(", ")", " ", "  ", "Cd", "e", ".", "é"]
    text = lambda n: "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(n))
    words = {f"k{i}": sorted({t.strip() for t in (text(rng.randrange(1, 4)) for _ in range(5)) if any(x.isalpha() for x in t)}) for i in range(6)}
    want, got, *_ = both(spark, [text(rng.randrange(0, 30)) for _ in range(150)], {k: v for k, v in words.items() if v})
    assert got == want and len(want) > 100


def test_empty_vocabulary(spark):
    docs = spark.createDataFrame([(1, "x")], "id long, text string")
    assert vocab.match_vocabulary(docs, spark.createDataFrame([("k", "...")], "key string, term string")).count() == 0


def test_large_vocabulary_takes_about_as_long(spark):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(30_000)}"
    docs = joins.stored(spark.createDataFrame([(i, " ".join(word() for _ in range(300))) for i in range(2_000)], "id long, text string"), "test-docs")
    terms = [(f"k{i % 50}", f"w{i % 30_000} {word()}") for i in range(100_000)]
    took = []
    for n in (100, 100, 100_000):
        table = joins.stored(spark.createDataFrame(terms[:n], "key string, term string"), "test-terms")
        began = time.time()
        vocab.match_vocabulary(docs, table).count()
        took.append(time.time() - began)
    assert took[2] < 2 * took[1] + 3, took
