"""Vocabularies and the versioned taxonomy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.text import folded, once, present, whole_word
from docweft.operators.joins import checked_broadcast, stored


def term_hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms the folded text contains; terms are literals of the plan, nothing is joined."""
    return sum((F.when(text.contains(" ".join(t.lower().split())), 1).otherwise(0) for t in terms if t.strip()), F.lit(0))


def suggest_category(docs: DataFrame, office: Column, content: Column, definitions: Sequence[Mapping]) -> DataFrame:
    """A10: adds ``category_key, category_score, category_confidence``: office terms count 8, content terms 3, aliases 2; the highest score
    wins, the lower ``sort_order`` on ties; ``other`` is never scored. Only the first 5,000 characters of ``content`` are the
    caller's choice."""
    office, content = folded(office), folded(content)
    both = F.concat_ws(" ", office, content)
    scored = []
    for d in sorted((d for d in definitions if d["category_key"] != "other"), key=lambda d: d["sort_order"]):
        hits = term_hits(office, d.get("office_terms", ()))
        score = 8 * hits + 3 * term_hits(content, d.get("content_terms", ())) + 2 * term_hits(both, d.get("aliases", ()))
        scored.append(F.struct(score.alias("score"), F.lit(-d["sort_order"]).alias("order"), F.lit(d["category_key"]).alias("key"), hits.alias("hits")))
    out = docs.withColumn("_best", F.array_max(F.array(*scored)))
    best = F.col("_best")
    confidence = F.when((best["hits"] > 0) | (best["score"] >= 8), "HIGH").when(best["score"] >= 4, "MEDIUM").otherwise("LOW")
    return out.withColumns(
        {
            "category_key": F.when(best["score"] > 0, best["key"]).otherwise("other"),
            "category_score": best["score"],
            "category_confidence": F.when(best["score"] > 0, confidence).otherwise("LOW"),
        }
    ).drop("_best")


def match_terms(text: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """Array of (key, term) of the whole words in the text, the longest found term of each key; one pattern for each key."""
    found = [F.struct(F.lit(k).alias("key"), present(F.regexp_extract(text, f"(?iu)({whole_word(terms)})", 1)).alias("term")) for k, terms in vocabulary.items()]
    none = F.array().cast("array<struct<key:string,term:string>>")
    return F.filter(F.array(*found), lambda m: m["term"].isNotNull()) if found else none


def resolve(text: Column, vocabulary: Mapping[str, Sequence[str]]) -> Column:
    """(key, ambiguous, candidates): the one key whose terms occur; several keys are ambiguous and give none."""
    return once(
        F.array_sort(F.transform(match_terms(text, vocabulary), lambda m: m["key"])),
        lambda keys: F.struct(
            F.when(F.size(keys) == 1, F.get(keys, F.lit(0))).alias("key"),
            (F.size(keys) > 1).alias("ambiguous"),
            F.array_join(F.when(F.size(keys) > 1, keys).otherwise(F.array().cast("array<string>")), ",").alias("candidates"),
        ),
    )


_WORD, _GAP = r"[\p{L}\p{M}\p{N}_]+", r"[^\p{L}\p{M}\p{N}_]+"


def _pieces(c: Column) -> Column:
    """Words and what stands between them, in turn: put together they are the text."""
    return F.regexp_extract_all(c, F.lit(f"({_WORD}|{_GAP})"), 1)


def compiled_terms(vocabulary: DataFrame) -> DataFrame:
    """A vocabulary table (``key, term``) as ``match_vocabulary`` looks it up: ``window`` (the lower-case term from its first word to its
    last), ``head`` (the first word), ``n_words``, and the signs ``pre`` and ``post`` around. Terms without a word match nothing."""
    pieces = F.col("_pieces")
    first = F.when(F.get(pieces, F.lit(0)).rlike(f"^{_WORD}$"), 0).otherwise(1)
    last = F.size(pieces) - F.when(F.element_at(pieces, -1).rlike(f"^{_WORD}$"), 1).otherwise(2)
    known = vocabulary.where("key IS NOT NULL").select("key", "term", _pieces(F.lower("term")).alias("_pieces")).where(F.exists("_pieces", lambda p: p.rlike(_WORD)))
    return known.select(
        "key",
        F.array_join(F.slice(pieces, first + 1, last - first + 1), "").alias("window"),
        F.get(pieces, first).alias("head"),
        F.floor((last - first) / 2 + 1).cast("int").alias("n_words"),
        F.when(first == 1, F.get(pieces, F.lit(0))).otherwise("").alias("pre"),
        F.when(last < F.size(pieces) - 1, F.element_at(pieces, -1)).otherwise("").alias("post"),
    ).distinct()


def match_vocabulary(docs: DataFrame, vocabulary: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """J12 with a vocabulary of any size: ``id, key, found, place`` for each row's keys, the rows that ``match_terms`` gives.

    ``found`` is the first occurrence of a term of the key as a whole word, whatever its case, the longest there; ``place`` is its number
    among words and gaps. A text is cut into words once. Each word meets the terms' first words, and only where one
    does are the stretches that so begin, as long as terms with that first word are, looked up. Both lookups are equi-joins, broadcast while the tables
    fit (``checked_broadcast``) and shuffled beyond, so the time for a text does not grow with the vocabulary. Null ids are no rows of the result.
    """
    terms = stored(compiled_terms(vocabulary), "vocabulary-terms")
    heads = stored(terms.groupBy("head").agg(F.sort_array(F.collect_set("n_words")).alias("lengths")), "vocabulary-heads")
    most = terms.agg(F.max("n_words")).first()[0]
    if most is None:
        return docs.select(F.col(id_col).alias("id"), F.lit(None).cast(vocabulary.schema["key"].dataType).alias("key"), F.lit("").alias("found"), F.lit(0).alias("place")).limit(0)
    pieces = F.col("_p")
    first_word = F.when(F.get(pieces, F.lit(0)).rlike(f"^{_WORD}$"), 0).otherwise(1)
    words = F.when(F.size(pieces) > first_word, F.sequence(first_word, F.size(pieces) - 1, F.lit(2)))
    word = lambda i: F.struct(i.alias("place"), F.lower(F.get(pieces, i)).alias("head"), F.get(pieces, i - 1).alias("before"), F.slice(pieces, i + 1, F.lit(2 * most + 1)).alias("ahead"))
    cut = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), _pieces(F.col(text_col)).alias("_p"))
    each = cut.select("id", F.explode(F.transform(words, word)).alias("w")).select("id", "w.*")
    begun = each.join(checked_broadcast(heads), "head").select("id", "place", "before", "ahead", F.explode("lengths").alias("n"))
    found = F.array_join(F.slice("ahead", F.lit(1), 2 * F.col("n") - 1), "")
    tried = begun.where(F.size("ahead") >= 2 * F.col("n") - 1).select("id", "place", "before", found.alias("found"), F.lower(found).alias("window"), F.get("ahead", 2 * F.col("n") - 1).alias("after"), (F.size("ahead") <= 2 * F.col("n")).alias("closed"))
    hits = tried.join(checked_broadcast(terms.drop("head", "n_words")), "window")
    # signs around a term are part of it, and no word may touch them
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    ok_before = (F.col("pre") == "") | (before.endswith(F.col("pre")) & ((F.length(before) > F.length("pre")) | (F.col("place") == 1)))
    ok_after = (F.col("post") == "") | (after.startswith(F.col("post")) & ((F.length(after) > F.length("post")) | F.col("closed")))
    whole = F.concat("pre", "found", "post")
    hits = hits.where(ok_before & ok_after).select("id", "key", "place", whole.alias("found"))
    first = F.min(F.struct(F.col("place"), (-F.length("found")).alias("_n"), F.col("found")))
    return hits.groupBy("id", "key").agg(first.alias("m")).select("id", "key", "m.found", "m.place")


def resolve_vocabulary(docs: DataFrame, vocabulary: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """A11 with a vocabulary table: ``id, key, ambiguous, candidates`` of each distinct id, as ``resolve`` gives them."""
    matched = match_vocabulary(docs, vocabulary, id_col=id_col, text_col=text_col)
    keys = matched.groupBy("id").agg(F.array_sort(F.collect_set(F.col("key").cast("string"))).alias("keys"))
    both = docs.select(F.col(id_col).alias("id")).distinct().join(keys, "id", "left")
    n = F.coalesce(F.size("keys"), F.lit(0))
    return both.select(
        "id", F.when(n == 1, F.get("keys", F.lit(0))).alias("key"), (n > 1).alias("ambiguous"), F.when(n > 1, F.array_join("keys", ",")).otherwise("").alias("candidates")
    )


def coverage_gaps(cases: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``case_id, term`` of expected terms that no pack has."""
    wanted = cases.select("case_id", F.explode("expected_terms").alias("term")).withColumn("folded", folded(F.col("term")))
    known = vocabulary.select(folded(F.col("term")).alias("folded")).distinct()
    return wanted.join(known, "folded", "left_anti").select("case_id", "term")


def join_current(docs: DataFrame, definitions: DataFrame, *, key: str = "category_key") -> DataFrame:
    """Adds ``category_label``: the open definition's name, else the key itself."""
    current = definitions.where("valid_to IS NULL").select(key, F.col("display_name").alias("_name"))
    return docs.join(current, key, "left").withColumn("category_label", F.coalesce("_name", key)).drop("_name")


def join_as_of(docs: DataFrame, definitions: DataFrame, at: str, *, key: str = "category_key") -> DataFrame:
    """Adds ``category_version`` and ``category_label`` of the definition that was valid at ``at``; an equi-join with a range on top."""
    d = definitions.select(F.col(key).alias("_key"), F.col("version").alias("category_version"), F.col("display_name").alias("category_label"), "valid_from", "valid_to")
    valid = (F.col(key) == F.col("_key")) & (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return docs.join(d, valid, "left").drop("_key", "valid_from", "valid_to")


def open_version_violations(definitions: DataFrame) -> DataFrame:
    """Keys that do not have exactly one open version."""
    n = definitions.groupBy("category_key").agg(F.count_if(F.col("valid_to").isNull()).alias("open_versions"))
    return n.where("open_versions <> 1")


def close_and_insert(definitions: DataFrame, changes: DataFrame) -> DataFrame:
    """Definitions with changes (``category_key, display_name, valid_from``) applied: every version ends where the next begins.

    New versions count on from the key's last; only ``valid_to`` of older rows is touched.
    """
    last = definitions.groupBy("category_key").agg(F.max("version").alias("_last"))
    order = Window.partitionBy("category_key").orderBy("valid_from", "display_name")
    new = changes.join(last, "category_key", "left").withColumn("version", (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("int"))
    cols = ["category_key", "version", "display_name", "valid_from"]
    whole = definitions.select(*cols, F.col("valid_to").alias("_to")).unionByName(new.select(*cols).withColumn("_to", F.lit(None).cast("timestamp_ntz")))
    by_version = Window.partitionBy("category_key").orderBy("version")
    return whole.withColumn("valid_to", F.coalesce("_to", F.lead("valid_from").over(by_version))).drop("_to")


def protected_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Versions of which anything but ``valid_to`` was changed."""
    old = before.select("category_key", "version", F.col("display_name").alias("_old_name"), F.col("valid_from").alias("_old_from"))
    both = after.join(old, ["category_key", "version"])
    same = F.col("display_name").eqNullSafe(F.col("_old_name")) & F.col("valid_from").eqNullSafe(F.col("_old_from"))
    return both.where(~same).select("category_key", "version")
