"""Token counts, decontamination, line dedup and packing against brute force."""

import hashlib
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from docweft.llm import decontaminate as dc
from docweft.llm import line_dedup as ld
from docweft.llm import packing, token_counts
from docweft.llm.common import shared_dir
from docweft.llm.queries_text import tokenizer_path
from docweft.llm.tokenizers import PieceEncoder
from pyspark.sql import functions as F


def own_cache(spark):
    return f"{shared_dir(spark)}/cache-{uuid.uuid4().hex}"


def test_token_counts_equal_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    cache = own_cache(spark)
    want = sorted(
        (str(r.doc_id), len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in odd.collect()
    )
    for _ in range(2):  # the second run finds all counts in the cache
        got = token_counts.count_tokens(odd, tokenizer=tokenizer_path(), cache=cache)
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == odd.fillna({"text": ""}).select("text").distinct().count()
    assert token_counts.count_tokens(empty, tokenizer=tokenizer_path(), cache=own_cache(spark)).count() == 0


def test_each_content_is_encoded_once_whatever_the_ids(spark):
    rows = [(None, "one text")] * 300 + [(7, "another")] * 50 + [(7, "one text"), (3, None), (3, ""), (4, "third"), (2, "third")]
    cache = own_cache(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert token_counts.count_tokens(docs, tokenizer=tokenizer_path(), cache=cache).count() == len(rows)
    assert spark.read.parquet(cache).count() == 4  # nothing is dropped before the cache is written


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    encoder = PieceEncoder(tokenizer_path(name))
    rng = random.Random(1)
    parts = ["a", "bc", " ", "  ", "\n", "\t", ".", "'s", "é", " the", "日本", "\r\n", "😀", "<|endoftext|>", "1", "\x85", "\x1c", "x" * 70]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)]
    got = [np.frombuffer(x, "<i4").tolist() for x in encoder.ids_of(texts)]
    assert got == [encoder.encode([t])[0] if t else [] for t in texts]


def test_pieces_survive_forgetting(monkeypatch):
    from docweft.llm import tokenizers

    texts = [" ".join(f"w{i * j % 97}" for j in range(30)) for i in range(50)]
    want = PieceEncoder(tokenizer_path()).ids_of(texts)
    monkeypatch.setattr(tokenizers, "REMEMBERED", 20)
    small = PieceEncoder(tokenizer_path())
    assert [small.ids_of([t])[0] for t in texts] == want


def brute_hits(text, items):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall((t or "").encode().lower())
    w, hit, found = cut(text), set(), set()
    for name, t in items:
        p = cut(t)
        if name is None or not p:
            continue
        m = min(13, len(p))
        wins = {tuple(p[i : i + m]) for i in range(len(p) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                found.add(str(name))
    n = len(hit)
    return len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)


@pytest.mark.parametrize("pattern_bytes", [8_000_000, 300])
def test_decontamination_matches_brute_force(spark, odd, empty, pattern_bytes):
    rng = random.Random(3)
    long = [f"w{rng.randrange(30)}" for _ in range(40)]
    items = [(1, " ".join(long)), (2, " ".join(long[5:30])), (10, "Two-three"), (3, ""), (4, None), (None, "one"), (5, "one"), (5, "line a"), (6, " ".join(["w1"] * 20))]
    texts = [" ".join(long[3:25]) + " tail", "x " * 300 + " ".join(long[:13]), " ".join(["w1"] * 40), "ONE, two; THREE!", " ".join(long[:12]), " ".join(rng.choices(long, k=500))]
    docs = odd.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words long"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_contamination(docs, bench, carry=["doc_id", "n_words"], pattern_bytes=pattern_bytes)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = sorted((str(r.doc_id), *brute_hits(r.text, items)) for r in docs.collect())
    assert sorted((str(r.doc_id), *r[1:]) for r in got.collect()) == want
    assert dc.find_contamination(empty, bench, carry=["doc_id"], pattern_bytes=pattern_bytes).count() == 0
    more = docs.selectExpr("*", "map('a', doc_id) as m", "'x' as items_sha256")  # a map cannot be grouped by; a name of a result
    again = dc.find_contamination(more, bench, carry=["doc_id", "m", "items_sha256", "text"], pattern_bytes=pattern_bytes)
    assert again.columns == ["doc_id", "m", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((str(r.doc_id), *r[3:]) for r in again.collect()) == want
    assert all(r.n_hit == 0 for r in dc.find_contamination(docs, bench.limit(0), carry=["doc_id"]).collect())


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows, min_docs, min_chars, keep_first):
    docs = defaultdict(set)
    for n, (_, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                docs[key(line)].add(n)
    often = {k for k, v in docs.items() if len(v) >= min_docs}
    seen, out = set(), {}
    for n, (_, t) in enumerate(rows):
        kept = []
        for line in (t or "").split("\n"):
            if key(line) in often and (not keep_first or key(line) in seen):
                continue
            if key(line) in often:
                seen.add(key(line))
            kept.append(line)
        out[n] = "\n".join(kept)
    return out


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize(("min_docs", "per_range"), [(3, 40), (2, 7), (10, 1000), (1, 5)])
def test_lines_match_brute_force(spark, keep_first, min_docs, per_range):
    rng = random.Random(min_docs)
    pool = ["Common", " common\t", "x", "", " ", "Ünï", "b  b", *[f"line {i}" for i in range(40)]]
    weights = [30, 20, 10, 9, 9, 5, 5, *[1] * 40]
    rows = [(i, "\n".join(rng.choices(pool, weights, k=rng.randint(1, 12)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n".join(["Common"] * 5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    drops = ld.line_drops(docs, min_docs=min_docs, min_chars=1, keep_first=keep_first, lines_per_range=per_range)
    want = brute_lines(rows, min_docs, 1, keep_first)
    got = {r.doc_id: r for r in ld.with_bitmaps(docs, drops).collect()}
    for n, (i, t) in enumerate(rows):
        assert "\n".join(ld.kept_lines(t, got[i].keep_bitmap, (t or "").count("\n") + 1)) == want[n], (i, t)


def test_repeated_rows_of_many_lines(spark):
    text = "\n".join(f"line {i}" for i in range(40)) + "\nown"
    rows = [(None, text)] * 400 + [(5, text)] * 30 + [(6, "own\nline 3\nelse")]
    drops = ld.line_drops(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), min_docs=10, lines_per_range=500)
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped) for r in drops.collect()) == [("5", 41, 41), ("6", 3, 2), ("None", 41, 41)]


def test_line_digests_on_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute_lines(rows, 2, 1, False)
    out = ld.line_digests(ld.with_bitmaps(odd, ld.line_drops(odd, min_docs=2))).collect()
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((str(r.doc_id), r.kept_sha256) for r in out) == sorted((str(i), digest(want[n])) for n, (i, _) in enumerate(rows))
    assert ld.line_digests(ld.with_bitmaps(empty, ld.line_drops(empty))).count() == 0


def test_best_fit_decreasing():
    rng = random.Random(0)
    for _ in range(200):
        most = rng.randint(1, 40)
        sizes = [rng.randint(1, most) for _ in range(rng.randint(0, 60))]
        rows = packing.best_fit_decreasing(sizes, most)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        free: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [f for f in free if f >= s]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - s)
            else:
                free.append(most - s)
        assert sorted(most - sum(sizes[i] for i in r) for r in rows) == sorted(free)


@pytest.mark.parametrize(("name", "end"), [("byte_bpe_50k.tiktoken", 50256), ("byte_bpe_50k.json", None), ("piece_bpe_32k.model", 2)])
def test_packing_round_trip(odd, empty, name, end):
    path = tokenizer_path(name)
    docs = odd.where("doc_id <> 20 OR doc_id IS NULL").dropDuplicates(["doc_id"])  # piece models take minutes for one word of 300,000 letters
    packed = packing.pack(docs, tokenizer=path, row_tokens=64, end_id=end, shard_bytes=200_000)
    width = packing.id_bytes(path, end)
    got = defaultdict(dict)
    for r in packing.unpack(packed, width).collect():
        got[r.doc_id][r.doc_start] = r.token_ids
    encoder = PieceEncoder(path)
    want = {r.doc_id: [*np.frombuffer(encoder.ids_of([r.text])[0], "<i4").tolist(), *([end] if end else [])] for r in docs.collect() if r.text}
    assert {i: [t for s in sorted(p) for t in p[s]] for i, p in got.items()} == {i: t for i, t in want.items() if t}
    for r in packed.collect():
        assert len(r.token_ids) == 64 * width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 64
        assert r.position_resets == r.cu_seqlens[:-1]
        positions = packing.position_ids(r.cu_seqlens)
        assert [i for i, p in enumerate(positions) if p == 0] == r.position_resets
    assert Counter((r.shard, r.row) for r in packed.collect()).most_common(1)[0][1] == 1
    assert packing.pack(empty, tokenizer=path, row_tokens=64).count() == 0


def test_packing_spreads_a_hot_id(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(None, f"text {i} " * 20) for i in range(300)] + [(7, "equal rows " * 20)] * 300
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer=path, row_tokens=64, shard_bytes=6_000)
    some = packed.select("shard", F.explode("doc_ids").alias("i")).groupBy("i").agg(F.count_distinct("shard").alias("n")).collect()
    assert {r.i for r in some} == {None, 7} and min(r.n for r in some) > 10
    starts = [s for r in packed.collect() for s in r.doc_starts]
    assert sum(s == 0 for s in starts) == 600
