"""Keyword search behind a persisted inverted index (X3, L4, F50-F52): the rows of ``search.search`` from the postings of a query's words.

A query's token has no white space or sign in it, so a text contains it exactly if one of the text's words does. The index therefore has postings
by word, and n-grams only of the distinct words: these lead from a token to the words that contain it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions.text import folded
from docweft.operators.joins import checked_broadcast, stored
from docweft.operators.search import SearchBackend, query_tokens, token_vector

#: Documents of one block of postings: 2 to this power.
BLOCK_BITS = 16
#: Matched words up to which the scan of postings is given them as a filter, so that row groups of other words are skipped.
LISTED_WORDS = 1_000


def word_grams(word: Column) -> Column:
    """Distinct pairs and triples of neighbouring characters of a word."""
    chars = F.filter(F.split(word, ""), lambda x: x != "")

    def of(n: int) -> Column:
        last = F.size(chars) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(chars, i + 1, n), ""))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of(2), of(3)))


def token_grams(token: str) -> list[str]:
    """What a word that contains the token must have."""
    return [token] if len(token) == 2 else sorted({token[i : i + 3] for i in range(len(token) - 2)})


class IndexedSearch(SearchBackend):
    """An index at ``path``: ``build`` writes it, ``search`` answers from it.

    * ``docs``: ``number, id`` and the kept columns; numbers ascend by the id as text, so the order of ties is that of numbers.
    * ``postings``: ``word, block, docs``: the documents of a block of 65,536 that have the word, sorted by word.
    * ``grams``: ``gram, word``, sorted by gram, over distinct words.

    Files are sorted by their key, so a lookup reads the row groups of its keys. Rows with a null id are indexed like others (first).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, docs: DataFrame, path: str, *, text: Column, id_col: str = "id", keep: Sequence[str] = ()) -> IndexedSearch:
        """Index whole texts (``text`` is folded searchable text, F48). Words are shuffled, texts are not; a posting list gathers one block."""
        rows = stored(docs.select(F.col(id_col).alias("id"), *keep, token_vector(text).alias("_words")), "index-words")  # ranges are sampled from these, not from texts
        rows = rows.withColumn("_by", F.col("id").cast("string")).repartitionByRange("_by").sortWithinPartitions("_by").drop("_by")
        rows = stored(rows.withColumn("number", F.monotonically_increasing_id()), "index-rows")
        rows.select("number", "id", *keep).write.parquet(f"{path}/docs")
        each = rows.select("number", F.explode("_words").alias("word"))
        block, place = F.shiftright("number", BLOCK_BITS), F.col("number").bitwiseAND(F.lit(2**BLOCK_BITS - 1)).cast("int")
        postings = each.groupBy("word", block.alias("block")).agg(F.sort_array(F.collect_list(place)).alias("docs"))
        postings.repartitionByRange("word", "block").sortWithinPartitions("word", "block").write.parquet(f"{path}/postings")
        words = docs.sparkSession.read.parquet(f"{path}/postings").select("word").distinct()
        grams = words.select("word", F.explode(word_grams(F.col("word"))).alias("gram"))
        grams.repartitionByRange("gram", "word").sortWithinPartitions("gram", "word").write.parquet(f"{path}/grams")
        return cls(docs.sparkSession, path)

    def _matched(self, tokens: Sequence[str]) -> DataFrame:
        """``token, word``: the index's words that contain each token."""
        need = [(g, t, len(token_grams(t))) for t in tokens for g in token_grams(t)]
        grams = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(sorted({g for g, _, _ in need})))
        need = F.broadcast(self.spark.createDataFrame(need, "gram string, token string, needed int"))  # a query's own grams
        found = grams.join(need, "gram").groupBy("token", "word", "needed").agg(F.count(F.lit(1)).alias("n")).where("n = needed")
        return stored(found.where(F.contains("word", "token")).select("token", "word"), "index-words")

    def search(self, docs: DataFrame | None, query: str, filters: Mapping[str, str | None] | None = None, limit: int = 20) -> DataFrame:
        """The ``limit`` best indexed rows with ``score``, as ``search.search`` orders them; kept columns can be filtered by.

        Blocks are bounded by the tokens that any of their postings has. Levels of score are tried from the highest bound down: documents of
        a level come only from blocks that reach it, and no lower level is read once ``limit`` rows are found. With ``docs``, its rows
        (by ``id``) are given in place of the index's columns.
        """
        weights = Counter(query_tokens(query))
        table = self.spark.read.parquet(f"{self.path}/docs")
        for name, value in (filters or {}).items():
            if value is not None:
                table = table.where(folded(F.col(name)) == folded(F.lit(value)))
        found = table.limit(0).withColumn("score", F.lit(0.0))
        if weights:
            found = self._best(table, weights, limit)
        found = found.drop("number")
        return found if docs is None else docs.join(F.broadcast(found.select("id", "score")), "id")  # at most ``limit`` rows

    def _best(self, table: DataFrame, weights: Counter, limit: int) -> DataFrame:
        matched = self._matched(sorted(weights))
        postings = self.spark.read.parquet(f"{self.path}/postings")
        few = [r[0] for r in matched.select("word").distinct().limit(LISTED_WORDS + 1).collect()]
        if len(few) <= LISTED_WORDS:
            postings = postings.where(F.col("word").isin(few))
        weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        hits = postings.join(checked_broadcast(matched), "word")
        bounds = hits.groupBy("block").agg(F.collect_set("token").alias("t"))
        total = lambda tokens: F.aggregate(tokens, F.lit(0), lambda n, t: n + F.element_at(weight, t))
        bounds = stored(bounds.select("block", total(F.col("t")).alias("bound")), "index-bounds")
        levels = sorted((r[0] for r in bounds.select("bound").distinct().collect()), reverse=True)  # at most one for each token
        found = table.limit(0).withColumn("score", F.lit(0.0))
        for level in range(levels[0] if levels else 0, 0, -1):
            blocks = checked_broadcast(bounds.where(F.col("bound") >= level).select("block"))
            each = hits.join(blocks, "block", "left_semi").select("token", (F.shiftleft("block", BLOCK_BITS)).alias("first"), F.explode("docs").alias("place"))
            scored = each.groupBy((F.col("first") + F.col("place")).alias("number")).agg(F.collect_set("token").alias("t"))
            scored = scored.select("number", total(F.col("t")).alias("hits")).where(F.col("hits") >= level)
            best = scored.join(table, "number").withColumn("score", F.round(F.col("hits") / float(sum(weights.values())), 4)).drop("hits")
            found = stored(best.orderBy(F.desc("score"), "number").limit(limit), "index-best")
            if found.count() >= limit:
                break
        return found
