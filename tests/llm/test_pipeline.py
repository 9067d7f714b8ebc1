"""The pipeline's stages against brute force on a small corpus."""

import random
import re

import pytest
from docweft.llm.common import stored
from docweft.llm.packing import unpack
from test_join import brute
from test_native import brute_mix
from test_texts import brute_hits

corpus_pipeline = pytest.importorskip("corpus_pipeline")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LEXICON = {"en": "the of and to in is that for it with as on be at by this are from or have".split(), "de": "der die und das ist nicht ein zu von mit sich auf für dem den auch werden aus er hat".split()}


def corpus():
    rng = random.Random(11)
    text = lambda lang, n: " ".join(rng.choice(LEXICON[lang]) + rng.choice(["", "", "x", "yo"]) for _ in range(n))
    items = [(i, text("en", 30)) for i in range(3)]
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "en", "de"])
        t = text(lang, rng.choice([20, 60, 150]))
        if i % 15 == 7:
            t = t[:80] + " " + items[i % 3][1]
        rows.append([t, lang, f"src{rng.randrange(4)}"])
    rows += [[rows[3][0].upper(), "en", "src1"], [rows[4][0] + " tail", "en", "src2"], [rows[3][0], None, None], [None, "en", "src0"], ["", "de", "src1"], ["123 456", "en", "src1"]]
    rng.shuffle(rows)
    return [(i, *r, 1) for i, r in enumerate(rows)], items


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows, items = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, str(at)), f"test-{name}")
        out.append((name, docs, made))
        docs = made
    return out, items, str(at)


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages[0]] == ["language_id", "ngram_jaccard", "decontaminate", "mix_sources", "pack_tokens"]
    assert corpus_pipeline.ORACLE_SQL is None
    for _, _, made in stages[0][:-1]:
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_match_brute_force(stages):
    by = {n: ({r.doc_id: r for r in a.collect()}, {r.doc_id: r for r in b.collect()}) for n, a, b in stages[0][:-1]}
    before, after = by["language_id"]
    assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    gone = [before[i].text for i in set(before) - set(after)]
    assert {None, "", "123 456"} <= set(gone) and len(gone) <= 4  # what has no letters goes, clean rows stay
    before, after = by["ngram_jaccard"]
    want = {i for i, (_, _, c) in brute([(i, r.text) for i, r in before.items()]).items() if c == i}
    assert set(after) == want and len(after) < len(before)
    before, after = by["decontaminate"]
    assert set(after) == {i for i, r in before.items() if not brute_hits(r.text, stages[1])[4]} and len(after) < len(before)
    before, after = by["mix_sources"]
    names = ["web", "books", "code"]
    rows = []
    for r in before.values():
        m = re.search(r"([0-9]{1,9})$", r.source or "")
        rows.append((r.doc_id, names[int(m[1]) % 3 if m else 2], r.lang or "unknown", r.source or "unknown", len(r.text.split())))
    want = brute_mix(rows, corpus_pipeline.WEIGHTS, corpus_pipeline.MIX_FRACTION, 1, corpus_pipeline.MIX_SEED)
    assert sorted(str((i, 1)) for i in after) == want and 0 < len(after) < len(before)


def test_packed_rows_hold_every_document(stages):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    _, docs, packed = stages[0][-1]
    got: dict = {}
    for r in unpack(packed, 2).collect():
        got.setdefault(r.doc_id, {})[r.doc_start] = r.token_ids
    texts = {i: coder.decode([t for s in sorted(p) for t in p[s]][:-1]) for i, p in got.items()}
    assert texts == {r.doc_id: r.text for r in docs.collect()}


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, stages[2])
    assert sorted(map(str, out.collect())) == sorted(map(str, stages[0][-1][2].collect()))


def test_clashing_extra_columns(spark, stages):
    docs = stages[0][0][1]
    more = docs.selectExpr("*", "'x' as contaminated", "1 as epoch", "2 as rejected", "3 as n_tokens", "4 as component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        more = stored(stage(spark, more, stages[2]), f"test-more-{name}")
    want = {r.doc_id for r in stages[0][3][2].collect()}
    assert {r.doc_id for r in more.collect()} == want and more.columns[-5:] == ["contaminated", "epoch", "rejected", "n_tokens", "component_id"]


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(3)
    a, b, c, d, e = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(60)) for _ in range(5))
    rows = [(5, a, "en", "s", 1), (5, a, "en", "s", 1), (5, a, "de", "s", 1)]  # repeated rows: one stays
    rows += [(2, b, "en", "s", 1), (None, b + " end", "en", "s", 1)]  # a null id goes before an id
    rows += [(9, b, "en", "s", 1), (9, c, "en", "s", 1)]  # one id, two texts: the unique one stays
    rows += [(None, d, "en", "s", 1), (None, d, "en", "t", 1), (None, e, "en", "s", 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, a, "de", "s", 1), (2, b, "en", "s", 1), (9, c, "en", "s", 1), (None, d, "en", "s", 1), (None, e, "en", "s", 1)]))


def test_near_duplicates_when_keys_collide(spark, stages, monkeypatch):
    """Rows whose hashes are the same are told apart: with seven bits most rows share theirs with others."""
    docs = stages[0][1][1]
    want = {r.doc_id for r in stages[0][1][2].collect()}
    for bits in (1, 7):
        monkeypatch.setattr(corpus_pipeline, "KEY_BITS", bits)
        assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, stages[2]).collect()} == want


def test_stages_on_odd_rows(spark, odd, empty, stages):
    """Null and repeated ids, null, empty and very long texts, and an empty table go through every stage."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = stored(odd.where("doc_id <> 20 OR doc_id IS NULL").select(*cols), "test-odd")  # one word of 300,000 letters takes tokenizers minutes
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stored(stage(spark, docs, stages[2]), f"test-odd-{name}")
        assert made.columns == cols and made.exceptAll(docs).count() == 0
        docs = made
    assert corpus_pipeline.STAGES[-1][1](spark, docs, stages[2]).count() > 0
    none = empty.select(*cols)
    for name, stage in corpus_pipeline.STAGES:
        none = stored(stage(spark, none, stages[2]), f"test-none-{name}")
        assert none.count() == 0
