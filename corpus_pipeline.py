"""From raw documents to packed token rows: five stages, each written and read again.

language ID > near duplicates > benchmark decontamination > source mixing > packed token ids.
Each stage takes all that its predecessor kept and returns the columns of documents, but for the last. Columns may have any
names besides these, and any of them may be null: a null text has no letters and goes in the first stage, a null language
teaches nothing, null languages and sources are the node ``unknown`` of the mix. Null and repeated ids are judged by id and text. Texts
count whole, however long; rows that are equal throughout are copies, of which one stays. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.llm import language_id
from docweft.llm.common import checked_broadcast, stored, table, tuned
from docweft.llm.decontaminate import find_contamination
from docweft.llm.jaccard_join import jaccard_join
from docweft.llm.mixing import mix
from docweft.llm.packing import pack
from docweft.llm.queries_native import WEIGHTS, source_domain
from docweft.llm.queries_packing import END_ID, ROW_TOKENS, TOKENIZER
from docweft.llm.queries_text import tokenizer_path

#: Share of the tokens that the mix aims for; every document is used once at most.
MIX_FRACTION = 0.8
MIX_SEED = 17
#: Bits of the first hash of a row's key in the near-duplicate stage.
KEY_BITS = 62


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no operator's results have, and the new name of each column."""
    names = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def kept(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*names.values()).toDF(*names)


def row_keys(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rows`` with ``_key``, equal where id and text are: a hash of both, or, where different rows have the same hash, another one
    from a range of its own. Told apart by both hashes together (``2 * KEY_BITS`` bits), as narrow rows."""
    h1, h2 = (F.xxhash64(F.lit(seed), F.col(id_col).isNull(), id_col, text_col).bitwiseAND(F.lit(2**bits - 1)) for seed, bits in ((1, KEY_BITS), (2, 62)))
    same = rows.select(h1.alias("_h1"), h2.alias("_h2")).groupBy("_h1").agg(F.min("_h2").alias("least"), F.max("_h2").alias("most"))
    same = checked_broadcast(stored(same.where("least <> most").select("_h1", F.lit(True).alias("_same")), "near-keys"))
    keyed = rows.withColumns({"_h1": h1, "_h2": h2}).join(same, "_h1", "left")
    return keyed.withColumn("_key", F.when(F.col("_same"), F.col("_h2") + F.lit(2**62)).otherwise(F.col("_h1"))).drop("_h1", "_h2", "_same")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the labelled rows; rows without letters and ties between languages go."""
    tuned(spark)
    rows, names = renamed(docs)
    model = language_id.fit(docs)
    judged = language_id.identify(rows, model, text_col=names["text"], carry=list(names.values()))
    return kept(judged.where("NOT rejected"), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that 5-word shingle Jaccard of 0.75 or more links, one row stays: the one with the smallest id (null
    after all others), then the smallest key of id and text. Of rows equal in both, the one whose other columns come first as json.

    Rows are told apart by that key, so a repeated id takes no other text along, and rows without id are judged like others.
    """
    tuned(spark)
    rows, names = renamed(docs)
    at, text = names["doc_id"], names["text"]
    rows = row_keys(rows, at, text)
    joined = jaccard_join(rows, id_col="_key", text_col=text).where("linked")
    linked = stored(joined.select(F.col("doc_id").alias("_key"), "component_id").distinct(), "near-linked")
    members = rows.select("_key", at).join(checked_broadcast(linked), "_key").groupBy("component_id", "_key")
    members = stored(members.agg(F.min(at).alias("id"), F.count(F.lit(1)).alias("n")), "near-members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key"))["_key"].alias("stays"))
    judged = members.join(checked_broadcast(stored(first, "near-first")), "component_id")
    gone = stored(judged.where("_key <> stays OR n > 1").select("_key", (F.col("_key") == F.col("stays")).alias("again")), "near-duplicates")
    out = kept(rows.join(checked_broadcast(gone.select("_key")), "_key", "left_anti"), names)
    again = stored(gone.where("again").select("_key"), "near-again")
    if not again.count():
        return out
    others = F.to_json(F.struct(*[c for c in names.values() if c != text]))
    one = rows.join(checked_broadcast(again), "_key", "left_semi").groupBy("_key").agg(F.min_by(F.struct(*names.values()), others).alias("row"))
    return out.unionByName(kept(one.select("row.*"), names))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which a twentieth of the words or more lies in benchmark passages go."""
    tuned(spark)
    rows, names = renamed(docs)
    judged = find_contamination(rows, table(spark, sf_dir, "benchmark"), text_col=names["text"], carry=list(names.values()))
    return kept(judged.where("NOT contaminated"), names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that domain, language and source budgets take, each once."""
    rows, names = renamed(docs)
    mixed = mix(
        rows,
        domain=source_domain(F.col(names["source"])),
        weights=WEIGHTS,
        target_fraction=MIX_FRACTION,
        max_epochs=1,
        seed=MIX_SEED,
        id_col=names["doc_id"],
        text_col=names["text"],
        lang_col=names["lang"],
        source_col=names["source"],
        carry=list(names.values()),
    )
    return kept(mixed, names)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids, packed best fit decreasing."""
    tuned(spark)
    return pack(docs, tokenizer=tokenizer_path(TOKENIZER), row_tokens=ROW_TOKENS, end_id=END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("pack_tokens", pack_tokens),
]

#: Compression, similarity search and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
