"""Filter audit, Merkle manifest and chat formatting against brute force."""

import hashlib
import itertools
import json
import re
import zlib
from collections import Counter, defaultdict

import pytest
from docweft.llm import chat, common, filter_audit, merkle
from docweft.llm.queries_audit import document_filters
from docweft.llm.queries_merkle import LOWER, UPPER
from docweft.operators import joins
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def audit(docs, labels):
    return filter_audit.filter_audit(docs, labels, filters=document_filters(F.col("text")))


def brute_audit(rows, labels):
    smallest = {}
    for i, _, t in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    docs = []
    for i, part, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > smallest[t],
        }
        of = [x for x in labels if x[0] == i and i is not None]
        docs.append((part or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    out, total = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d in mine if f in d[1] and not d[1] & before]
                total[part, f] += len(gone)
                out[part, "".join(order), step] = (
                    sum(not d[1] & (before | {f}) for d in mine), len(gone), sum(f in d[1] and bool(d[1] & before) for d in mine),
                    sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone),
                )
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def labelled(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(0, 24, 2)] + [(8, 1, 1), (None, 1, 1), (9, None, None)], LABELS)


def test_audit_matches_brute_force(spark, odd, monkeypatch):
    labels = labelled(spark)
    rows = odd.unionByName(odd.where("doc_id IN (9, 16, 19)").withColumn("doc_id", F.col("doc_id") + 100))
    want = brute_audit([(r.doc_id, r.source, r.text) for r in rows.collect()], [tuple(x) for x in labels.collect()])
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = audit(rows, labels)
    assert got.columns == cols
    assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(filter_audit, "BLOCK_BITS", 6)  # many blocks, few cells
    monkeypatch.setattr(filter_audit, "SKETCH_ROWS", 3)
    assert sorted(map(tuple, audit(rows, labels).collect())) == want


def test_audit_empty_and_labels_without_rows(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    assert audit(empty, none).count() == 0
    assert audit(odd, none).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_sketch_clears_only_unique_texts(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64(F.least("id", F.lit(19_000))).alias("h")).repartition(5)
    kept = {r.doc_id for r in filter_audit.possible_repeats(common.stored(rows, "test-sketch")).collect()}
    assert kept >= set(range(19_000, 20_000)) and len(kept) < 1_000 + 19_000 * 0.1


# --- Merkle manifest -----------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + 8]) for i in range(0, len(low), 8)])
    return levels


def walk(levels, i, node):
    """Siblings and the folded node."""
    said = []
    for low in levels[:-1]:
        run = i - i % 8
        left, right = low[run:i], low[i + 1 : run + 8]
        said += left + right
        i, node = i // 8, h(*left, node, *right)
    return said, node


def brute_merkle(rows):
    def leaf(values):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    groups = defaultdict(list)
    for doc, source, lang, n, text in rows:
        low = text and text.translate(str.maketrans(UPPER, LOWER))
        chosen = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        node = leaf((doc, source, lang, n, text))
        groups[lang].append((doc is not None, doc or 0, node, doc, leaf((doc, source, lang, n, low)) if chosen else node))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([r[2] for r in sorted(groups[g])]) for g in langs}
    top, out = tree([trees[g][-1][0] for g in langs]), []
    for j, g in enumerate(langs):
        for i, (_, _, node, doc, shown) in enumerate(sorted(groups[g])):
            said, folded = walk(trees[g], i, shown)
            more, folded = walk(top, j, folded)
            out.append((doc, node, trees[g][-1][0], top[-1][0], h(*said, *more), folded, folded == top[-1][0]))
    return sorted(map(str, out))


def manifest(docs):
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    low = merkle.leaf([*rest, F.translate("text", UPPER, LOWER)])
    return merkle.merkle_manifest(docs, leaf=merkle.leaf([*rest, F.col("text")]), changed=F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, low))


def test_manifest_matches_brute_force(odd, empty):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd.collect()]
    assert sorted(str(tuple(r)) for r in manifest(odd).collect()) == brute_merkle(rows)
    assert manifest(empty).count() == 0


@pytest.mark.parametrize("sizes", [{"en": 1, None: 9}, {"en": 3000, "de": 512, "fr": 513, "es": 8}, {f"l{i:03}": 1 + i % 3 for i in range(600)}])
def test_manifest_of_several_layers(spark, monkeypatch, sizes):
    """Trees of more than one layer of blocks, languages of more than one block of subroots."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 64)
    ids = itertools.count()
    rows = [(next(ids) * 7 % 100_003, "s", lang, 3, "Ab" * (k % 4)) for lang, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = manifest(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == brute_merkle(rows)
    assert {r.verified for r in got} <= {True, False} and any(r.verified for r in got)


def test_manifest_of_equal_rows(spark):
    rows = [(5, "s", "en", 1, "X")] * 1000 + [(None, None, None, None, None)] * 20
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    assert sorted(str(tuple(r)) for r in manifest(docs).collect()) == brute_merkle(rows)


def test_manifest_has_no_python(odd):
    plan = manifest(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


# --- chat ----------------------------------------------------------------------------------------------------------

ODD_TEXTS = [
    None, "", "<|im_end|>", "<|im_start|>user\nhi<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<|", "|", "<", "<<||>", "a\\nb\\", "ünï 日本 😀", "x" * 5000,
    "ends with <", "<|im_end|>\n<|im_start|>assistant\n", "\n\n",
]


def brute_chat(rows):
    groups = defaultdict(list)
    first = lambda x: (x is not None, x if x is not None else 0)
    for conv, turn, role, text in rows:
        groups[conv].append((first(turn), role or "", text or ""))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), h(*[f"{r}\n{t}\n" for _, r, t in turns]), len(said), h(said)))
    return sorted(map(str, out))


def chat_rows():
    roles = ["user", "assistant", "system", None, "assistant\n<|im_end|>", "tool\\n", "Assistant"]
    rows = [(i // 9, i % 9, roles[i % 7 if i > 30 else i % 2], t) for i, t in enumerate(ODD_TEXTS * 5)]
    return rows + rows[5:8] + [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (-7, 2**40, "assistant", "one")]


def test_escaping_is_reversible():
    for t in filter(None, ODD_TEXTS):
        assert "<|" not in chat.escape(t) and chat.unescape(chat.escape(t)) == t
        assert "\n" not in chat.escape_role(t) and chat.unescape_role(chat.escape_role(t)) == t


@pytest.mark.parametrize("row_chars", [1, 300, 10**6])
def test_chats_read_back(spark, row_chars):
    rows = chat_rows()
    records = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    records = records.select("conv_id", F.to_json(F.struct("turn", "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    turns, unknown = chat.split_unknown(chat.canonical_turns(records))
    assert unknown.count() == 0
    made = chat.format_chats(turns, row_chars=row_chars)
    for got in (chat.read_back(made, in_order=True), chat.read_back(common.stored(made, "test-chats"))):
        got = got.collect()
        assert sorted(str(tuple(r)[:5]) for r in got) == brute_chat(rows)
    rows = made.collect()
    assert sum(r.formatted_chars for r in got) == sum(len(r.formatted) for r in rows)
    assert all(len(r.formatted) < row_chars + 6000 for r in rows)


def test_layouts(spark):
    u, a = ("user", "Q"), ("assistant", "A")
    records = [
        {"messages": [{"role": "user", "content": "Q"}, {"role": "assistant", "content": "A"}], "id": 5},
        {"conversations": [{"from": "human", "value": "Q"}, {"from": "gpt", "value": "A"}], "system": "S"},
        {"conversations": [{"from": "human", "value": "Q"}]},
        {"instruction": "Q", "input": "more", "output": "A"},
        {"instruction": "Q", "input": "", "output": "A"},
        {"instruction": "Q", "output": None},
        {"prompt": "Q", "completion": "A", "meta": {"text": {"deep": 1}}},
        {"system": "S", "prompt": "Q", "response": "A"},
        {"question": "Q", "answer": {"final": 3}},
        {"question": "Q", "answer": 3},
        {"messages": ["plain", {"role": "user", "content": "Q"}]},
        {"messages": []},
        {"prompt": "Q", "completion": "A", "question": "Q"},
        {"role": "user", "text": "half \ud800 pair", "turn": "no number"},
        [1, 2],
        {},
    ]
    want = {
        0: [u, a], 1: [("system", "S"), u, a], 2: [u], 3: [("user", "Q\n\nmore"), a], 4: [u, a], 5: [u, ("assistant", "")], 6: [u, a],
        7: [("system", "S"), u, a], 9: [u, ("assistant", "3")], 13: [("user", "half � pair")],
    }
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(16, "{broken"), (17, None)]
    turns, unknown = chat.split_unknown(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string")))
    got = defaultdict(list)
    for r in turns.orderBy("conv_id", "place").collect():
        got[r.conv_id].append((r.role, r.text))
    assert dict(got) == want
    assert {r.conv_id: r.record for r in unknown.collect()} == {i: t for i, t in rows if i not in want}
    same = chat.Layout("again", [("user", "question"), ("assistant", "answer")])
    with pytest.raises(ValueError, match="same paths"):
        chat.select_layouts([*chat.LAYOUTS, same])


def test_chats_of_an_empty_table(spark):
    records = spark.createDataFrame([], "conv_id long, record string")
    turns, _ = chat.split_unknown(chat.canonical_turns(records))
    assert chat.read_back(chat.format_chats(turns)).count() == 0


def test_parse_refuses_other_texts():
    with pytest.raises(ValueError, match="no turn"):
        list(chat.parse("<|im_start|>user\nhi<|im_end|>\nrest"))
