"""N-gram Jaccard join against brute force; components."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from docweft.llm import jaccard_join as jj
from docweft.llm.components import components


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, percent=75):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    links = Counter()
    for i, s in sets.items():
        for j, o in Counter(j for x in s for j in inverted[x] if j > i).items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), links[i], find(i)) for i, s in sets.items()}


def family_rows(seed):
    """Families of copies and near copies, chains, shared passages and a hot line."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 5, 8, 30, 120, 200]))]
        for _ in range(rng.choice([1, 1, 2, 4, 12])):
            t = base.copy()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.4:
                t = passage + t
            rows.append(" ".join(t))
            base = t if rng.random() < 0.3 else base  # a chain drifts away from its start
    rows += [None, "", "  \n", rows[0].upper(), rows[0].replace(" ", "\n")]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("counting", [True, False])
@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"hot_rows": 2, "block_tokens": 500}), (3, {"hot_rows": 3, "block_tokens": 120, "hot_tokens": 20})])
def test_join_matches_brute_force(spark, seed, options, counting, monkeypatch):
    monkeypatch.setattr(jj, "MANY", 3)
    rows = family_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    got = {r.doc_id: r for r in jj.jaccard_join(docs, count_links=counting, **options).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (w[0], w[2]) for i, w in want.items()}
    assert {i: r.linked for i, r in got.items()} == {i: w[1] > 0 for i, w in want.items()}
    assert not counting or {i: r.n_links for i, r in got.items()} == {i: w[1] for i, w in want.items()}


def test_hot_group_of_near_copies(spark):
    """A group that fills many chunks, drifting ends, and texts that share its words without linking."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        t = base.copy()
        t[rng.randrange(60)] = f"x{i}"
        rows.append(" ".join(t))
    for i in range(25):  # a chain away from the group
        base = base[2:] + [f"c{2 * i}", f"c{2 * i + 1}"]
        rows.append(" ".join(base))
    rows += [" ".join([f"b{j}" for j in range(20)] + [f"o{i}_{j}" for j in range(20)]) for i in range(10)]
    rows = list(enumerate(rows))
    want = brute(rows)
    for tokens in (300, 1500):
        got = {r.doc_id: r.component_id for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block_tokens=tokens).collect()}
        assert got == {i: w[2] for i, w in want.items()}


def test_join_on_odd_rows(odd, empty):
    out = jj.jaccard_join(odd, count_links=True).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out}
    for i in (0, 1, 2, 3, 4):
        assert (by[i].n_shingles, by[i].n_links, by[i].linked, by[i].component_id) == (0, 0, False, i)
    assert by[6].component_id == 5 and by[8].component_id == 7  # case and blanks do not count
    assert {by[i].component_id for i in (9, 10, 11, 12)} == {9} and by[9].n_links == 4  # the repeated row is a copy
    assert by[None].component_id is None
    plain = jj.jaccard_join(odd)
    assert plain.columns == ["doc_id", "n_shingles", "linked", "component_id"]
    assert sorted(map(str, plain.collect())) == sorted(str(r).replace(f"n_links={r.n_links}, ", "") for r in out)
    assert jj.jaccard_join(empty).count() == 0


def test_join_of_repeated_ids(spark):
    """Rows that repeat an id with other texts are each judged by their own text."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, b + " end"), (3, a + " end"), (4, "apart from all the others here")]
    got = sorted((r.doc_id, r.component_id) for r in jj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


def pairs_of(sets, **options):
    s = jj.Search(sets, 75, **options)
    return {(q, int(d)) for q in s.asking for d in s.links(q)}


def long_lists():
    rng = random.Random(5)
    passage = list(range(10**6, 10**6 + 60))
    sets = []
    for _ in range(60):
        own = rng.sample(range(10**5), 100)
        sets += [sorted(own + passage), sorted(own[:95] + rng.sample(range(10**5), 5) + passage)]
    return [np.unique(np.array(s, np.int64)) for s in sets]


def test_search_with_long_lists():
    """Passages that all members share are probed, not merged, and nothing is lost."""
    arrays = long_lists()
    want = set()
    for i, a in enumerate(arrays):
        for j in range(i + 1, len(arrays)):
            o = len(np.intersect1d(a, arrays[j]))
            if 100 * o >= 75 * (len(a) + len(arrays[j]) - o):
                want.add((i, j))
    assert pairs_of(arrays) == want and len(want) >= 60
    both = pairs_of(arrays, n_first=50)
    assert both == {(i, j) for i, j in want if i < 50 <= j}
    label, links = jj.count_links(jj.Search(arrays, 75), np.arange(len(arrays)), np.ones(len(arrays), int))
    assert links.sum() == 2 * len(want) and (jj.connect(jj.Search(arrays, 75), np.arange(len(arrays))) == label).all()


def test_search_across_sides_and_blocks():
    a = np.arange(20, dtype=np.int64)
    assert pairs_of([a] * 4, n_first=2) == {(0, 2), (0, 3), (1, 2), (1, 3)}
    assert pairs_of([a] * 2, n_first=2) == set()
    assert pairs_of([a] * 3, blocked=[[7], [7], []]) == {(0, 2), (1, 2)}
    assert pairs_of([a] * 3, roots=np.array([5, 5, 6])) == {(0, 2), (1, 2)}


def test_connect_skips_what_is_connected(monkeypatch):
    """Members of a large component do not ask, those of others find them, whatever the order."""
    rng = random.Random(1)
    for seed in range(30):
        rng.seed(seed)
        base = [f"b{i}" for i in range(40)]
        texts = [base[:], *([*base[:i], f"x{n}", *base[i + 1 :]] for n, i in enumerate(rng.choices(range(40), k=20)))]
        texts += [base[i:] + [f"t{j}" for j in range(i)] for i in range(0, 40, 2)] + [[f"o{n}_{j}" for j in range(30)] + base[:10] for n in range(6)]
        rng.shuffle(texts)
        sets = [np.sort(np.array([hash(tuple(t[i : i + 3])) for i in range(len(t) - 2)], np.int64)) for t in texts]
        reps = np.array(rng.sample(range(1000), len(sets)))
        want, _ = jj.count_links(jj.Search(sets, 75), reps, np.ones(len(sets), int))
        for many in (2, 5, 16):
            monkeypatch.setattr(jj, "MANY", many)
            assert (jj.connect(jj.Search(sets, 75), reps) == want).all()


def test_search_time_grows_with_the_lists_not_the_members():
    import time

    rng = np.random.default_rng(0)
    took = []
    for n in (2000, 8000):
        sets = [np.unique(rng.integers(0, 50 * n, 60)) for _ in range(n)]
        began = time.process_time()
        assert not pairs_of(sets)
        took.append(time.process_time() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_divide_never_takes_all():
    for sizes, t in (([5, 5, 5], 1), ([100, 100, 2, 1], 3), ([9], 1), ([1] * 50, 40)):
        assert 0 <= jj.divide(np.array(sizes), t) < t


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(60)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_heap_merge_counts_members():
    rng = random.Random(12)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(rng.randrange(1, 9))]
        for least in (1, 2, len(lists)):
            found, have = jj.heap_merge(lists, least)
            want = {m: n for m in range(40) if (n := sum(m in x for x in lists)) >= least}
            assert dict(zip(found.tolist(), have.tolist(), strict=True)) == want and found.tolist() == sorted(want)
        flat, sizes = np.array([x for y in lists for x in y]), np.array([len(y) for y in lists])
        for n in (40, 400):  # counted, merged
            found, have = jj.merged_counts(flat, np.cumsum(sizes) - sizes, sizes, n, 2)
            assert dict(zip(found.tolist(), have.tolist(), strict=True)) == {m: k for m in range(40) if (k := sum(m in x for x in lists)) >= 2}
    assert jj.heap_merge([], 1)[0].size == 0
