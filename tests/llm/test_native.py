"""Exact dedup and mixing."""

import hashlib
import re
from collections import defaultdict

from docweft.llm import common, mixing
from docweft.llm import exact_dedup as ed
from docweft.llm.queries_native import source_domain
from docweft.operators import joins
from pyspark.sql import functions as F


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_dedup_matches_brute_force(odd):
    rows = [(r.doc_id, norm(r.text)) for r in odd.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = sorted(
        (str(i), str(min((x for x in groups[t] if x is not None), default=None)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows
    )
    got = ed.exact_dedup(odd, digest_all=True).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len(groups)  # one row of each text, though ids repeat


def test_dedup_keeps_one_of_equal_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "b"), (None, "c"), (3, "c")]
    got = ed.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((str(r.doc_id), r.group_size) for r in got if r.kept) == [("1", 3), ("3", 2), ("None", 2)]


def test_dedup_reads_only_surviving_groups(odd):
    out = {r.doc_id: r for r in ed.exact_dedup(odd).collect()}
    assert out[5].text_sha256 is None and out[5].group_size == 1  # "one" shares its length with "One" only
    assert out[9].group_size == 3 and out[10].keep_id == 9


def test_dedup_empty_and_shuffled_join(empty, odd, monkeypatch):
    assert ed.exact_dedup(empty).count() == 0
    few = sorted(map(str, ed.exact_dedup(odd, digest_all=True).collect()))
    monkeypatch.setattr(ed, "checked_broadcast", lambda small, limit=0: small)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    for hot in (10_000, 3):  # no group, or those of three rows and more, apart from the others
        monkeypatch.setattr(joins, "HOT_ROWS", hot)
        assert sorted(map(str, ed.exact_dedup(odd, digest_all=True).collect())) == few


def test_rows_without_key_are_kept_and_not_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame([(i, x, 1) for i, x in enumerate(["a", "a", "b", None, "c", None])], "id int, k1 string, k2 int")
    totals = spark.createDataFrame([("a", 1, 2, 7), ("b", 1, 1, 8)], "k1 string, k2 int, size int, least int")
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    for how, want in (("left", [7, 7, 8, None, None, None]), ("inner", [7, 7, 8])):
        for size in (64_000_000, 0):
            monkeypatch.setattr(joins, "BROADCAST_BYTES", size)
            got = common.with_totals(rows, totals, ["k1", "k2"], "size", how).orderBy("id").collect()
            assert [r["least"] for r in got] == want


def test_native_plans_have_no_python(odd):
    for df in (ed.exact_dedup(odd), mixing.mix(odd, domain=F.lit("web"), weights={})):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


def fill(children, budget):
    """Water filling by repeated rounds; children: name -> (weight, cap)."""
    budget = min(budget, sum(c for _, c in children.values()))
    full: dict = {}
    while True:
        rest = {k: v for k, v in children.items() if k not in full}
        left = budget - sum(full.values())
        total = sum(w for w, _ in rest.values())
        new = {k: c for k, (w, c) in rest.items() if c * total <= left * w}
        if not new:
            return full | {k: left * w // total for k, (w, _) in rest.items()}
        k = min(new, key=lambda k: (children[k][1] / children[k][0], k))
        full[k] = children[k][1]


def brute_mix(rows, weights, fraction, epochs, seed):
    leaves = defaultdict(list)
    for i, dom, lang, src, n in rows:
        if n:
            leaves[dom, lang, src].append((i, n))
    supply = {k: sum(n for _, n in v) for k, v in leaves.items()}
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    cap = lambda *p: sum(s for k, s in supply.items() if k[: len(p)] == p) * epochs
    chosen = []
    top = fill({d: (w("domain", d), cap(d)) for d in {k[0] for k in supply}}, int(sum(supply.values()) * fraction))
    for d, b in top.items():
        mid = fill({x: (w("lang", x), cap(d, x)) for x in {k[1] for k in supply if k[0] == d}}, b)
        for lang, b2 in mid.items():
            low = fill({s: (w("source", s), cap(d, lang, s)) for s in {k[2] for k in supply if k[:2] == (d, lang)}}, b2)
            for s, b3 in low.items():
                docs = leaves[d, lang, s]
                whole, rest = divmod(b3, supply[d, lang, s])
                chosen += [(i, e) for e in range(1, whole + 1) for i, _ in docs]
                place = lambda i: hashlib.md5(f"{seed}:{whole + 1}:{'' if i is None else i}".encode()).hexdigest()
                by = defaultdict(list)
                for i, n in docs:
                    by[place(i)].append((i, n))
                upto = 0
                for p in sorted(by):
                    upto += sum(n for _, n in by[p])
                    if upto > rest:
                        break
                    chosen += [(i, whole + 1) for i, _ in by[p]]
    return sorted(map(str, chosen))


def test_mix_matches_brute_force(odd):
    weights = {"domain": {"web": 5, "books": 3, "code": 2}, "lang": {"en": 6, "de": 2}}
    names = ["web", "books", "code"]
    rows = []
    for r in odd.collect():
        m = re.search(r"([0-9]{1,9})$", r.source or "")
        rows.append((r.doc_id, names[int(m[1]) % 3 if m else 2], r.lang or "unknown", r.source or "unknown", len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
    for fraction, epochs in ((0.5, 1), (0.9, 2), (2.5, 3), (0.0, 1)):
        got = mixing.mix(odd, domain=source_domain(F.col("source")), weights=weights, target_fraction=fraction, max_epochs=epochs, seed=3)
        assert sorted(str((r.doc_id, r.epoch)) for r in got.collect()) == brute_mix(rows, weights, fraction, epochs, 3), (fraction, epochs)


def test_mix_empty_carry_and_bad_weights(empty, odd):
    assert mixing.mix(empty, domain=F.lit("web"), weights={}).count() == 0
    out = mixing.mix(odd, domain=F.lit("web"), weights={}, target_fraction=1.0, max_epochs=1, carry=["text", "lang", "score"])
    assert out.columns == ["doc_id", "domain", "lang", "source", "epoch", "n_tokens", "text", "score"]
    try:
        mixing.weight_of("lang", {"lang": {"en": 0}})
    except ValueError:
        return
    raise AssertionError("weights of 0 are refused")
