"""Vector search, the projection forest and near-duplicate texts against brute force."""

import random

import numpy as np
import pytest

from rollcall.llm import forest, minhash, topk

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id bigint, embedding array<double>, label int, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], VECTORS)


def clean(v):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v)


@pytest.fixture(scope="module")
def embedded():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((60, 20))
    rows = [(int(i), (base[i % 60] + rng.standard_normal(20) * 0.05 * (i % 4)).tolist(), int(i % 3) if i % 11 else None) for i in range(700)]
    odd = [None, [], [0.0] * 20, [NAN] * 20, [INF] + [0.0] * 19, [None] + [1.0] * 19, [1.0, 2.0], [2.0, 4.0], rows[5][1], rows[5][1]]
    rows += [(1000 + 50 * i, v, 2) for i, v in enumerate(odd)]
    return rows + [(None, rows[7][1], 1), rows[8], rows[8]]


def test_top_k(spark, embedded):
    found = {}
    for r in topk.top_k(vectors(spark, embedded).repartition(3), lambda i: i % 50 == 0, block=7).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    usable = [(i, np.floor(256 * np.array(v))) for i, v, _ in embedded if i is not None and clean(v)]
    for q, x in usable:
        if q % 50 == 0:
            scored = sorted((-int(x @ y), i) for i, y in usable if i != q and len(y) == len(x))[:5]
            assert sorted(found.pop(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert not found


def test_top_k_of_large_components(spark):
    rows = [(i, [float(3 * 10**8 + i), -float(10**7 * i), 1.0], 0) for i in range(0, 120)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors(spark, rows), lambda i: i == 50, scale=1.0).collect())
    x = [int(c) for c in rows[50][1]]
    best = sorted((-sum(a * int(b) for a, b in zip(x, v, strict=True)), i) for i, v, _ in rows if i != 50)[:5]
    assert got == [(50, k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e150, 1.0], 0), (50, [1.0, 2.0], 0), (1, [1e300, 1.0], 0), (2, [1e306, 0.0], 0), (3, [-1e200, 5.0], 0), (4, [3.0, 1.0], 0), (5, [2.0, 2.0], 0)]
    got = {}
    for r in topk.top_k(vectors(spark, rows), lambda i: i % 50 == 0, scale=256.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    last = 2**63 - 1
    # 2's scaled component is infinite: it takes no part
    assert sorted(got[50]) == [(1, 0, last), (2, 1, last), (3, 5, 6 * 65536), (4, 4, 5 * 65536), (5, 3, -last)]
    assert [s for _, _, s in sorted(got[0])] == [last, last, last, last, -last]


def test_no_queries(spark, embedded):
    assert topk.top_k(vectors(spark, embedded), lambda i: i < -5).count() == 0
    assert topk.top_k(vectors(spark, []), lambda i: i % 50 == 0).count() == 0


def brute_links(rows, least):
    usable = [(i, np.array(v, float), label) for i, v, label in rows if i is not None and label is not None and clean(v) and np.any(np.array(v) != 0)]
    degree, parent = {}, {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(usable)):
        for b in range(a):
            (i, x, l), (j, y, m) = usable[a], usable[b]
            if l == m and len(x) == len(y) and (x @ y) / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                degree[i], degree[j] = degree.get(i, 0) + 1, degree.get(j, 0) + 1
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return degree, {i: root(i) for i in parent}


@pytest.mark.parametrize("leaf,block", [(forest.LEAF, forest.BLOCK), (64, 40)])
def test_forest(spark, embedded, monkeypatch, leaf, block):
    monkeypatch.setattr(forest, "LEAF", leaf)
    monkeypatch.setattr(forest, "BLOCK", block)
    rows = [r for r in embedded if r[0] is not None and r[0] != 8] + [(None, embedded[7][1], 1)]
    degree, component = brute_links(rows, 0.93)
    got = {r.vec_id: r for r in forest.link(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got.values()) >= (1.0 if leaf > 700 else 0.97) * sum(degree.values())
    assert all(r.n_links <= degree.get(i, 0) for i, r in got.items())
    if leaf > 700:
        assert {i: r.component_id for i, r in got.items() if i is not None} == {i: c for i, c in component.items() if i is not None}
        assert all(r.kept == (i == r.component_id) for i, r in got.items() if i is not None)
    assert got[None].kept and got[None].n_links == 0


def test_forest_of_extreme_norms_and_repeated_rows(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (3, [3.0, 3.1], 1), (4, [-1e200, 1.0], 1), (5, [2.0, 2.0], 1), (5, [2.0, 2.0], 1), (5, [2.0, 2.0], 1), (6, [5e-324, 5e-324], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in forest.link(vectors(spark, rows)).collect())
    assert got == [(1, 6, 1), (2, 6, 1), (3, 6, 1), (4, 0, 4), (5, 6, 1), (5, 6, 1), (5, 6, 1), (6, 6, 1)]


def test_forest_recall_on_many_clustered_vectors():
    """One label of 320,000 vectors in clusters, with planted pairs just above the threshold."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((200, 64))
    x = forest.unit(centres[rng.integers(0, 200, 320_000)] + 0.9 * rng.standard_normal((320_000, 64)))
    away = rng.standard_normal((2000, 64))
    away -= (away * x[:2000]).sum(axis=1, keepdims=True) * x[:2000]
    near = 0.935 * x[:2000] + (1 - 0.935**2) ** 0.5 * forest.unit(away)
    depth = int(np.ceil(np.log2(len(x) / forest.LEAF)))
    f = forest.Forest(64, depth).fit(x[rng.choice(len(x), forest.LEAF_SAMPLE << depth)], 0.93)
    row, leaf = f.leaves(x[:100_000])
    at, meets = f.leaves(near)
    own = set(zip(row.tolist(), leaf.tolist()))
    recall = len({i for i, n in zip(at.tolist(), meets.tolist()) if (i, n) in own}) / len(near)
    assert recall >= 0.98
    assert len(row) / 100_000 < 20 and np.bincount(np.unique(leaf, return_inverse=True)[1]).max() * 3.2 < 6 * forest.LEAF


def test_forest_recall_through_the_trees(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAF", 128)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((400, 16))
    rows = [(i, (base[i % 400] + 0.12 * rng.standard_normal(16)).tolist(), 1) for i in range(2000)]
    degree, component = brute_links(rows, 0.93)
    got = {r.vec_id: r for r in forest.link(vectors(spark, rows)).collect()}
    assert all(r.n_links <= degree.get(i, 0) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * sum(degree.values())
    assert sum(got[i].component_id == component[i] for i in got) >= 0.98 * len(got)


def test_forest_of_nothing(spark):
    assert forest.link(vectors(spark, [])).count() == 0
    assert [r.n_links for r in forest.link(vectors(spark, [(1, None, 1), (2, [1.0], None)])).collect()] == [0, 0]


def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randrange(12, 90))
        out.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            near = list(base)
            for _ in range(rng.randrange(1, 8)):
                near[rng.randrange(len(near))] = rng.choice(words)
            out.append("  ".join(near).upper() if rng.random() < 0.3 else " ".join(near))
    out += ["", None, "  ", "one", "ONE", "one two", "É é", "é É", "x" * 5000, out[0], out[3] + " tail"]
    return [(3 * i + 5, t) for i, t in enumerate(out)] + [(None, out[0]), (5, out[0])]


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sets, {i: root(i) for i in ids}


@pytest.mark.parametrize("width,block", [(2, minhash.BLOCK), (5, 3)])
def test_near_duplicates(spark, monkeypatch, width, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = texts()
    sets, component = brute_components(rows, width, 80)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, n int, id int")
    got = minhash.near_duplicates(df, width=width).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == component[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def copies_of(base, n, changed, rng):
    out = []
    for k in range(n):
        near = list(base)
        for at in rng.sample(range(len(base)), changed):
            near[at] = f"c{k}x{at}"
        out.append(" ".join(near))
    return out


@pytest.mark.parametrize("hub", [True, False])
def test_groups_of_near_copies_cost_their_size(spark, monkeypatch, hub):
    """With the text itself among its copies, it links them all; without it, most do not link at all."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    found = copies_of(base, 300, 4, rng)
    if hub:
        found.insert(150, " ".join(base))
    rows = [(i, t) for i, t in enumerate(found)]
    made, plain = [], minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df: made.append(plain(df)) or made[-1])
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=5).collect()}
    sets, component = brute_components(rows, 5, 80)
    assert {i: r.component_id for i, r in got.items()} == component
    assert (len(set(component.values())) == 1) == hub
    counts = {tuple(df.columns): df.count() for df in made}
    members = counts["v", "key", "n", "c"]
    assert counts["src", "dst"] <= 12 * len(rows) and counts["key", "i", "j", "own", "v", "c"] <= (0 if hub else members)


def test_one_id_of_two_texts(spark):
    long, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, long), (5, long + " tail"), (5, other), (7, other), (9, None), (9, None), (None, long), (None, long)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, _id int, _hash string")
    got = sorted((str(r.doc_id), r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == [("3", 3), ("5", 3), ("5", 5), ("7", 5), ("9", 9), ("9", 9), ("None", None), ("None", None)]
    kept = minhash.without_copies(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [("3", long), ("5", other), ("None", long), ("None", long)]
    assert sum(r.text is None for r in kept.collect()) == 1


def test_no_texts(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("likeness,stays", [(0.95, True), (0.85, True), (0.8, True), (0.68, False), (0.2, False)])
def test_sketches_tell_similar_sets_apart(likeness, stays):
    sampler, rng = minhash.Sampler(), np.random.default_rng(3)
    for _ in range(20):
        pool = rng.permutation(np.unique(rng.integers(0, 1 << 63, 4200, np.uint64)))
        common = int(4000 * likeness / (1 + likeness)) + 1
        a, b = pool[:2000], np.concatenate([pool[:common], pool[2000 : 4000 - common]])
        odd = sampler.sketch(sampler.samples(a)) ^ sampler.sketch(sampler.samples(b))
        assert (np.bitwise_count(odd.view(np.uint64)).sum() <= minhash.most_odd_bits(0.8)) == stays
