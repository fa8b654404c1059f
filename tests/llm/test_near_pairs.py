"""The near-copies stage on planted pairs and groups of known similarity."""

import numpy as np

import corpus_pipeline
from lectern.llm import simhash


def shingles(words, width=5):
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def jaccard(a, b):
    one, two = shingles(a.lower().split()), shingles(b.lower().split())
    return len(one & two) / len(one | two)


def planted(seed, levels, n):
    """``n`` pairs of texts for each level of Jaccard similarity, up to 0.02 above it."""
    r, out = np.random.default_rng(seed), {x: [] for x in levels}
    while any(len(x) < n for x in out.values()):
        a = [f"w{x}" for x in r.integers(0, 10**6, r.integers(200, 500))]
        b = list(a)
        for k in r.choice(len(a), r.integers(1, len(a) // 8), replace=False):
            b[k] = f"c{k}"
        one, two = shingles(a), shingles(b)
        for x in out:
            if 0 <= len(one & two) / len(one | two) - x < 0.02 and len(out[x]) < n:
                out[x].append((" ".join(a), " ".join(b)))
    return out


def stage(spark, sf_dir, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return [(x.doc_id, x.text) for x in corpus_pipeline.one_of_near_copies(spark, docs, sf_dir).collect()]


def test_planted_pairs(spark, sf_dir):
    levels = (0.5, 0.6, 0.7, 0.77, 0.8, 0.85, 0.9, 0.95)
    pairs = planted(5, levels, 100)
    texts = [t for x in pairs.values() for pair in x for t in pair]
    kept = {i for i, _ in stage(spark, sf_dir, enumerate(texts))}
    assert all(k in kept for k in range(0, len(texts), 2))  # the smaller id of a pair stays
    gone = {x: sum(200 * j + 2 * k + 1 not in kept for k in range(100)) for j, x in enumerate(pairs)}
    print(gone)
    assert all(gone[x] == 0 for x in levels[:4])  # under 0.8 nothing goes
    assert gone[0.8] >= 90 and gone[0.85] >= 96 and gone[0.9] >= 99 and gone[0.95] == 100


def test_groups_match_all_pairs(spark):
    """Groups of many versions, each changed a little from an earlier one, against components of all similar pairs."""
    r = np.random.default_rng(8)
    texts = []
    for _ in range(12):
        versions = [[f"w{x}" for x in r.integers(0, 10**6, 120)]]
        for _ in range(r.integers(1, 40)):
            own = list(versions[r.integers(len(versions))])
            for k in r.choice(120, r.integers(1, 4), replace=False):
                own[k] = f"c{r.integers(10**6)}"
            versions.append(own)
        texts += [" ".join(v) for v in versions]
    order = r.permutation(len(texts))
    texts = [texts[k] for k in order]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {x.doc_id: x.first.doc_id for x in simhash.near_copies(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    want = {k: find(k) for k in range(len(texts))}
    assert all(want[k] == want[got[k]] for k in got)  # nothing is tied that should not be
    assert len(set(got.values())) <= 1.1 * len(set(want.values()))


def test_no_similar_candidate_is_lost(spark):
    """Versions at similarities around 0.8: the forest of candidates takes nearer edges that don't hold, yet each candidate that holds links its texts."""
    r = np.random.default_rng(17)
    texts = []
    for _ in range(60):
        first = [f"w{x}" for x in r.integers(0, 10**6, 150)]
        for _ in range(12):
            own = list(first)
            for k in r.choice(150, r.integers(1, 4), replace=False):
                own[k] = f"c{r.integers(10**6)}"
            texts.append(" ".join(own))
    sets = [np.unique(simhash.shingles(t.encode(), 5)) for t in texts]
    fps = np.array([[simhash._signs(simhash._mixed(h, f)) for f in range(5)] for h in sets], np.uint64)
    got = {x.doc_id: x.first.doc_id for x in simhash.near_copies(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    held, a, b = [], [], []
    for i in range(len(texts)):
        for j in range(i // 12 * 12, i):
            far = np.bitwise_count(fps[i] ^ fps[j])
            if ((far <= 8) & (np.roll(far, -1) <= 20)).any():
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                held.append(shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared))
                a.append(j)
                b.append(i)
    assert 100 < sum(held) < len(held) - 100
    assert [(i, j) for i, j, x in zip(a, b, held) if x and got[i] != got[j]] == []


def test_pairs_of_a_group_match_all_pairs(spark):
    """All sets of a group compared, in one part and in many, against plain sets."""
    r = np.random.default_rng(23)
    sets = [np.unique(np.concatenate([r.choice(40, r.integers(20, 40), replace=False), r.integers(100, 120, r.integers(0, 5))])) for _ in range(120)] + [np.zeros(0, np.int64)]
    label = [int(x) for x in r.integers(0, 100, 121)]
    similar = [(i, j) for i in range(121) for j in range(i) if len(sets[i]) and len(sets[j]) and (n := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    assert len(similar) > 50

    def classes(edges):
        root = list(label)
        for a, b in edges:
            root = [root[a] if x == root[b] else x for x in root]
        return {frozenset(k for k in range(121) if root[k] == x) for x in root}

    rows = spark.createDataFrame([(k % 2, label[k] * 2 + k % 2, k, s.tolist()) for k, s in enumerate(sets)], "near long, label long, id long, own array<long>")
    one = rows.selectExpr("0L AS near", "label div 2 AS label", "id", "own")
    for together in (1 << 20, 300):
        got = [(x.a, x.b) for x in simhash._links_within(one, 0.8, together).collect()]
        assert set(map(tuple, map(sorted, got))) <= set(map(tuple, map(sorted, similar))) and classes(got) == classes(similar)
        assert all(x.a % 2 == x.b % 2 for x in simhash._links_within(rows, 0.8, together).collect())


def test_what_counts_as_a_document(spark, sf_dir):
    text, other = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(1, text), (1, text), (1, other), (2, text.upper()), (3, other + " x"), (None, text), (None, text), (4, None), (5, ""), (6, " \n"), (7, "a b c"), (8, "A  b c"), (9, "a b")]
    got = sorted(stage(spark, sf_dir, rows), key=str)
    assert got == sorted([(1, text), (1, other), (None, text), (None, text), (4, None), (7, "a b c"), (9, "a b")], key=str)
    long = "same words over and over " * 50_000  # a set of few shingles
    assert {i for i, _ in stage(spark, sf_dir, [(1, long), (2, long + "and other"), (3, "same words over and over")])} == {1, 2, 3}
