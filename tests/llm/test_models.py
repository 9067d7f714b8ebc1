"""Language ID, quality and toxicity: brute force on small corpora, held-out accuracy on the given tables, odd rows."""

import math
import os
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from docweft.llm import language_id, quality, toxicity
from docweft.llm.common import held_out, table
from docweft.llm.samples import labelled_sample

AT = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(AT), reason="the given tables are elsewhere")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    s = np.asarray(score)[order]
    i = 0
    while i < len(s):
        j = i
        while j < len(s) and s[j] == s[i]:
            j += 1
        rank[order[i:j]] = (i + j + 1) / 2
        i = j
    y = np.asarray(y)
    n1, n0 = y.sum(), (1 - y).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@given
def test_language_held_out(spark):
    docs, out = table(spark, AT, "documents"), held_out("doc_id", 4, 2)
    got = language_id.identify(docs.withColumn("held_out", out), language_id.fit(docs.where(~out)), carry=["doc_id", "held_out", "lang"])
    rows = got.where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_on_odd_rows(spark, odd, empty):
    model = language_id.fit(odd)
    rows = language_id.identify(odd, model, carry=["doc_id", "score", "lang_pred"]).collect()
    assert len(rows) == odd.count() and rows[0].__fields__ == ["doc_id", "lang_pred", "score", "margin", "rejected"]
    by = {r.doc_id: r for r in rows}
    for i in (0, 1, 2, 3, 4, 17):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert all(r.lang_pred in ("en", "de", "und") for r in rows)
    assert language_id.identify(empty, model).count() == 0
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(odd, none).collect()} == {"und"}


def test_language_model_is_deterministic(spark, odd):
    a, b = language_id.fit(odd), language_id.fit(odd.repartition(5))
    assert a.langs == b.langs and a.dictionaries == b.dictionaries


SYLLABLES = {
    "en": "the ing tion and er ly th wh ea ou ed re".split(), "de": "sch ein ung der ich keit zu ver ge pf ü ß".split(),
    "fr": "eau que ment é è oi aux la ou tion elle ç".split(), "fi": "kka nen ssa yy öö lla ää tta juo hdu vie mme".split(),
}


def made_up(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_language_rejects_unlearned_and_mixed(spark):
    rows = [(i, made_up(x, 600, i), x) for i, x in enumerate(["en", "de", "fr"] * 120)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(f"clean {x}", made_up(x, n, 1000 + n)) for n in (8, 30, 100, 1000, 5000) for x in ("en", "de", "fr")]
    asked += [("unlearned", made_up("fi", n, 1)) for n in (100, 1000, 5000)]
    asked += [("mixed", made_up("en", n, 2000) + " " + made_up("de", n, 2000)) for n in (100, 1000, 5000)]
    got = language_id.identify(spark.createDataFrame(asked, "kind string, text string"), model, carry=["kind"]).collect()
    for r in got:
        assert r.rejected == (r.kind in ("unlearned", "mixed")), r
        assert r.rejected or r.kind == f"clean {r.lang_pred}"
    assert any(r.margin >= 1 for r in got if r.rejected)


def test_language_learns_bodies_and_every_label(spark):
    header = made_up("en", 200, 0)
    rows = [(i, header + " " + made_up(x, 200, i), x) for i, x in enumerate(["de", "fr"] * 40)]
    rows += [(1000 + i, made_up("en", 200, i), "en") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    one = model.scorer()
    assert all(one(made_up(x, 100, 5000))[0] == x for x in ("en", "de", "fr"))
    bodies = [d for x, d in zip(model.langs, model.dictionaries, strict=True) if x == "de"][0]
    assert bodies.count(b"sch") > 40 and not bodies.startswith(language_id.letters(header)[:100])
    many = spark.createDataFrame([(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x " * 30, f"l{i:03}") for i in range(230)], "doc_id long, text string, lang string")
    model = language_id.fit(many)
    assert len(model.langs) == 230 and {r.lang_pred == r.lang for r in language_id.identify(many, model, carry=["lang"]).collect()} == {True}


def test_language_learns_a_label_of_a_few_letters(spark):
    rows = [(i, "the quick brown fox jumps over it " * 3, "en") for i in range(20)] + [(99, "zażó", "pl")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(docs, language_id.fit(docs), carry=["doc_id"]).where("doc_id = 99").first()
    assert got.lang_pred == "pl"


def test_language_learns_rows_of_one_id(spark):
    rows = [(None if i % 2 else 7, made_up(x, 30, i), x) for i, x in enumerate(["en", "de", "fr"] * 500)]
    rows += [(9, "juo nnen sskayy öölla", "fi")] * 1000  # equal rows
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows_per_lang=20)
    assert sorted(model.langs) == ["de", "en", "fi", "fr"] and all(len(d) > 2000 for x, d in zip(model.langs, model.dictionaries, strict=True) if x != "fi")
    assert all(model.scorer()(made_up(x, 30, 9000))[0] == x for x in ("en", "de", "fr"))


@given
@pytest.mark.parametrize(("module", "label", "folds", "fold", "least"), [(quality, "quality", 3, 1, 0.95), (toxicity, "toxic", 5, 0, 0.9)])
def test_classifier_held_out(spark, module, label, folds, fold, least):
    docs, labels, out = table(spark, AT, "documents"), table(spark, AT, "labels"), held_out("doc_id", folds, fold)
    model = module.fit(docs, labels.where(~out))
    score = module.score_quality if module is quality else module.score_toxicity
    rows = score(docs, model, carry=["doc_id"]).join(labels, "doc_id").where(out).collect()
    assert auc([r.score for r in rows], [r[label] for r in rows]) > least
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_rows(spark, odd, empty, module):
    label = "quality" if module is quality else "toxic"
    score = module.score_quality if module is quality else module.score_toxicity
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(5, 0), (None, 1), (7, None), (999, 1)], f"doc_id long, {label} int")
    model = module.fit(odd, labels)
    rows = score(odd, model, carry=["doc_id", "score", "lang"]).collect()
    assert len(rows) == odd.count() and rows[0].__fields__[:3] == ["doc_id", "lang", "score"]
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (0, 1, 2, 3, 4)}) == 1
    assert score(empty, model).count() == 0
    for few in (labels.limit(0), labels.where(f"{label} = 1")):  # one class or none: the smoothed share
        assert len({round(r.score, 9) for r in score(odd, module.fit(odd, few)).collect()}) == 1
    assert score(odd, module.fit(empty, labels)).count() == odd.count()


def small_corpus(kind):
    """Texts with class words, ties, repeated and empty rows; labels of most."""
    rng = random.Random(kind)
    plain, bad = [f"w{i}" for i in range(60)], [f"bad{i}" for i in range(4)]
    rows, labels = [], []
    for i in range(150):
        y = int(rng.random() < 0.3)
        t = [rng.choice(plain) for _ in range(rng.choice([3, 10, 40]))] + ([rng.choice(bad) for _ in range(2)] if y and rng.random() < 0.9 else [])
        rng.shuffle(t)
        rows.append((i, " ".join(t).capitalize() + rng.choice([".", "!!", ""])))
        labels.append((i, y if rng.random() < 0.95 else 1 - y))
    rows += [(150, None), (151, ""), (152, "unseenword only"), (153, rows[3][1]), (154, rows[3][1]), (155, "w1 " * 3000 + "bad1 bad2"), (156, "№ ½")]
    labels += [(153, 0), (154, 1), (151, 0)]
    return rows, labels


def brute_toxicity(rows, labels, k, lift, sure):
    """The scores by plain dicts: every example is compared with every text."""
    counts = lambda t: Counter(re.findall(r"\w+", (t or "").lower()))
    text, label = dict(rows), dict(labels)
    n1, n0 = sum(label.values()), len(label) - sum(label.values())
    df, df1 = Counter(), Counter()
    for i, y in label.items():
        df.update(counts(text[i]).keys())
        df1.update(w for w in counts(text[i]) if y)
    weight = {}
    for w, n in df.items():
        apart = df1[w] * n0 - (n - df1[w]) * n1
        chi2 = (n0 + n1) * apart**2 / (n * (n0 + n1 - n)) / (n0 * n1)
        weight[w] = (math.log((n0 + n1 + 1) / (n + 1)) + 1) * (1 + lift * math.sqrt(max(0.0, chi2 - sure**2)))

    def vector(t):
        raw = {w: (1 + math.log(n)) * weight[w] for w, n in counts(t).items() if w in weight}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    examples = [(i, label[i], vector(text[i])) for i in sorted(label)]

    def near(v, without=None):
        every = [(round(sum(x * e[2].get(w, 0) for w, x in v.items()), 9), e[0], e[1]) for e in examples if e[0] != without]
        return sorted((c for c in every if c[0] > 0), key=lambda c: (-c[0], c[1]))[:k]

    def vote(found):
        return sum(c for c, _, y in found if y) / sum(c for c, _, _ in found)  # the whole sample: classes weigh the same

    own = [(vote(f), y) if (f := near(v, i)) else (None, y) for i, y, v in examples]
    # isotonic regression: the largest of the least means of what lies from below to above
    seen = sorted(x for x, _ in own if x is not None)
    mean = lambda a, b: np.mean([y for x, y in own if x is not None and a <= x <= b])
    points = sorted(set(seen))
    level = {x: max(min(mean(a, b) for b in points if b >= x) for a in points if a <= x) for x in points}
    size = Counter(round(level[x], 12) for x in seen)
    value = {x: (level[x] * size[round(level[x], 12)] + 0.5) / (size[round(level[x], 12)] + 1) for x in points}
    none = [y for x, y in own if x is None]
    bare = (0.5 + sum(none)) / (1 + len(none)) if none else (n1 + 1) / (n0 + n1 + 2)
    out = {}
    for i, t in rows:
        found = near(vector(t)) if t else []
        v = vote(found) if found else None
        out[i] = bare if v is None else 0.99 * float(np.interp(v, points, [value[x] for x in points])) + 0.01 * v, [c[0] for c in found[:3]]
    return out


def test_toxicity_matches_brute_force(spark):
    rows, labels = small_corpus("toxic")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), k=5)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model, carry=["doc_id"]).collect()}
    want = brute_toxicity(rows, labels, 5, 3.0, 2.0)
    assert set(got) == set(want)
    for i, (score, cosines) in want.items():
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].neighbour_cosines == pytest.approx(cosines, abs=1e-6)
    assert got[152].neighbour_ids == [] and got[153].neighbour_ids[0] == 3 and got[155].score > 0.5


def test_nearest_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(0, 8), replace=False))
        x = rng.random(len(t)) + 0.01
        vectors.append((t, x / np.sqrt(x @ x) if len(t) else x))
    vectors[10:14] = [vectors[9]] * 4  # ties
    index = toxicity.BlockMaxIndex(vectors, 60)
    every = np.zeros((500, 60))
    for i, (t, x) in enumerate(vectors):
        every[i, t] = x
    for q in [*range(0, 500, 7), 9, 10]:
        got = index.nearest(*vectors[q], 10, without=q)
        cosine = [(round(float(c), 12), i) for i, c in enumerate(every @ every[q]) if i != q]
        want = sorted((e for e in cosine if e[0] > 0), key=lambda e: (-e[0], e[1]))[:10]
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want]
    tied = index.nearest(*vectors[9], 4, without=9)
    assert len(vectors[9][0]) == 0 or [i for _, i in tied] == [10, 11, 12, 13]
    assert toxicity.BlockMaxIndex([], 5).nearest(np.array([1]), np.array([1.0]), 3) == []


def brute_quality(rows, labels, c, epochs, seed, min_rows):
    """Log-count ratios and the dual in plain floats."""
    text, label = dict(rows), dict(labels)
    ids = sorted(label)
    sets = {i: quality.grams(t) for i, t in rows}
    n1, n0 = sum(label.values()), len(label) - sum(label.values())
    n = {y: Counter(g for i in ids if label[i] == y for g in sets[i]) for y in (0, 1)}
    ratio = {g: math.log((n[1][g] + 1) / (n1 + 2)) - math.log((n[0][g] + 1) / (n0 + 2)) for g in n[0].keys() | n[1].keys() if n[0][g] + n[1][g] >= min_rows}
    assert text

    def descend(some):
        w, bias, alpha, order = dict.fromkeys(ratio, 0.0), 0.0, [0.0] * len(some), np.random.default_rng(seed)
        for _ in range(epochs):
            most = 0.0
            for j in order.permutation(len(some)):
                own, sign = [g for g in sets[some[j]] if g in ratio], 2 * label[some[j]] - 1
                slope = sign * (sum(w[g] * ratio[g] for g in own) + bias) - 1
                new = min(max(alpha[j] - slope / (sum(ratio[g] ** 2 for g in own) + 1), 0.0), c)
                step = (new - alpha[j]) * sign
                for g in own:
                    w[g] += step * ratio[g]
                bias += step
                most, alpha[j] = max(most, abs(step)), new
            if most < 1e-4:
                break
        return lambda i: sum(w[g] * ratio[g] for g in sets[i] if g in ratio) + bias

    margin = np.zeros(len(ids))
    for k in range(3):
        of = descend([x for j, x in enumerate(ids) if j % 3 != k])
        for j, x in enumerate(ids):
            if j % 3 == k:
                margin[j] = of(x)
    slope, shift = quality.logistic_fit(margin, np.array([label[i] for i in ids]), np.ones(len(ids)))
    of = descend(ids)
    return {i: 1 / (1 + math.exp(-(slope * of(i) + shift))) for i, _ in rows}


def test_quality_matches_brute_force(spark):
    rows, labels = small_corpus("quality")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), min_rows=3)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, model, carry=["doc_id"]).collect()}
    assert got == pytest.approx(brute_quality(rows, labels, 0.03, 30, 1, 3), abs=1e-6)


def test_sample_takes_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, "b")] * 300 + [(1, "a"), (2, "c"), (None, "d"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, 1), (9, 0)], "doc_id long, toxic int")
    sample, counts = labelled_sample(docs, labels, "toxic", 2)
    assert sorted(map(tuple, sample.collect())) == [(1, 1, "a"), (2, 0, "c"), (3, 1, None)] and counts == {1: 2, 0: 2}


def brute_letters(text):
    """Letters and the marks on them, one space between words."""
    out, on = [], False
    for ch in (text or "").lower():
        kind = unicodedata.category(ch)[0]
        on = kind == "L" or (kind == "M" and on)
        out.append(ch if on else " ")
    return " ".join("".join(out).split())


def test_letters_are_unicode_letters():
    for t in ["½²", "① ② ③", "Ⅷ", "हिन्दी भाषा", "\u0301a b\u0301 1\u0301c", "É-Ç 12 ab_c", "A1B", "日本語 ｔｅｘｔ", "a\u200bb", "ªº", None, "", "İstanbul", "x\x00y"]:
        assert language_id.letters(t).decode() == brute_letters(t), t
    assert not language_id.letters("½² ① Ⅷ ٣")


def test_language_matches_brute_force(spark):
    """Sizes, predictions, scores and rejection by plain calls of the library, text by text."""
    import zstandard as z

    rows = [(i, made_up(x, 50, i), x) for i, x in enumerate(["en", "de", "fr"] * 60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [t for x in ("en", "de", "fr", "fi") for n in (1, 5, 60, 4000) for t in (made_up(x, n, 7000 + n),)] + ["½²", "", None, "123", "a", made_up("en", 40, 1) + made_up("de", 40, 2)]
    got = language_id.identify(spark.createDataFrame(list(enumerate(asked)), "i int, text string"), model, carry=["i"]).collect()
    less = max(0, 16 - max(8192, *map(len, model.dictionaries)).bit_length())
    settings = z.ZstdCompressionParameters(strategy=z.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=15 - less, chain_log=16 - less, search_log=3, write_content_size=False, write_checksum=False, write_dict_id=False)
    for r in got:
        data = brute_letters(asked[r.i]).encode()
        if not data:
            assert (r.lang_pred, r.score, r.margin, r.rejected) == ("und", 0.0, 0, True)
            continue
        sizes = {}
        for lang, d in zip(model.langs, model.dictionaries, strict=True):
            raw = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=settings)
            one = z.ZstdCompressor(dict_data=raw, compression_params=settings)
            sizes[lang] = sum(len(one.compress(data[i : i + 8192] + bytes(48))) for i in range(0, len(data), 8192))
        order = sorted(model.langs, key=lambda x: (sizes[x], model.langs.index(x)))
        least, second = sizes[order[0]], sizes[order[1]]
        assert (r.lang_pred, r.margin) == (order[0], second - least)
        assert r.score == pytest.approx(1 / sum(2.0 ** (least - s) for s in sizes.values()))
        assert r.rejected == (second - least < max(1, model.needed(order[0], least)))


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(200):
        label = i % 2
        rows.append(np.unique(np.r_[rng.integers(10, 60, 8), rng.integers(0, 5, 2) + 5 * label]))
        y.append(2 * label - 1)
    w = quality.svm_dual(rows, np.ones(60), np.array(y, float), np.full(200, 1.0), 60, 50, 1)
    assert all(np.sign(w[r].sum() + w[-1]) == s for r, s in zip(rows, y, strict=True))


def test_monotone_fit():
    x, y = np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 0, 1.0])
    places, values = toxicity.monotone(x, y, np.ones(5))
    assert (np.diff(values) >= 0).all() and (np.diff(places) >= 0).all() and 0 < values[0] and values[-1] < 1


def test_held_out_fold(spark):
    import zlib

    rows = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").withColumn("h", held_out("doc_id", 4, 2)).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
