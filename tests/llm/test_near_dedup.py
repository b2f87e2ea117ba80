import math
import random
import re
from collections import Counter

import numpy as np

from sitelake.llm import components as K
from sitelake.llm import probminhash as N


def bag(text):
    w = re.findall(r"(?:[^\x00-\x7f]|[a-z0-9])+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jp(a, b):
    x, y = ({k: 1 + math.log(v) for k, v in c.items()} for c in (a, b))
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in set(x) & set(y))


def brute(docs):
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    bags = {d: bag(t) for d, t in docs}
    for i, (d, t) in enumerate(docs):
        for e, u in docs[:i]:
            if (t or "") == (u or "") or jp(bags[d], bags[e]) >= 0.8:
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in docs}


def family(rng, n, words, change):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(w if rng.random() > change else f"x{rng.randrange(10**6)}" for w in base) for _ in range(n)]


def test_hashed_shingles_give_exact_similarity():
    rng = random.Random(1)
    texts = [*family(rng, 6, 60, 0.03), "a b c d e a b c d e a b c d e a b", "a b c d e a b c d e", "one two", "One, TWO!", "", None, "é日 ü x y z w"]
    of, h, times = N.shingles(texts)
    own = [(h[of == i], N.weight(times[of == i])) for i in range(len(texts))]
    for i in range(len(texts)):
        assert len(own[i][0]) == len(bag(texts[i]))
        for j in range(len(texts)):
            assert abs(N.probability_jaccard(*own[i], *own[j]) - jp(bag(texts[i]), bag(texts[j]))) < 1e-9
    low, high = N.bounds(of, h, N.weight(times), len(texts))
    exact = np.array([[jp(bag(t), bag(u)) for u in texts] for t in texts])
    two = ~np.eye(len(texts), dtype=bool)
    assert (low <= exact + 1e-9)[two].all() and (exact <= high + 1e-9)[two].all()


def test_registers_agree_as_often_as_the_similarity():
    rng = random.Random(4)
    texts = [family(rng, 1, 80, 0)[0]]
    texts += [texts[0] + " " + family(rng, 1, 40, 0)[0], "a b c d e " * 40 + texts[0]]
    of, h, times = N.shingles(texts)
    r = N.sketch(of, h, N.weight(times), len(texts), 4096)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert abs((r[i] == r[j]).mean() - jp(bag(texts[i]), bag(texts[j]))) < 0.04


def classes(df, **options):
    return {r.doc_id: (r.class_id, r.class_size) for r in N.near_duplicate_classes(df, **options).collect()}


def joined(n, links):
    label = list(range(n))
    for i, j in links:
        label = [label[i] if x == label[j] else x for x in label]
    return [label.index(x) for x in label]


def test_spanning_links_join_what_all_similar_pairs_join():
    for seed in range(20):
        rng = random.Random(seed)
        texts = [*family(rng, 12, 60, 0.03), *family(rng, 8, 30, 0.02), "a b c d e a b c d e a b c d e a b", "a b c d e a b c d e"]
        texts += [t + " " + t.split(" ", 1)[1] for t in texts[:6]]  # shingles of other weights
        n = len(texts)
        of, h, times = N.shingles(texts)
        pairs = [(i, j) for i in range(n) for j in range(i) if jp(bag(texts[i]), bag(texts[j])) >= 0.8]
        links = N.spanning_links(np.arange(n), of, h, N.weight(times), 0.8)
        assert {(max(p), min(p)) for p in links} <= set(pairs)
        assert joined(n, links) == joined(n, pairs) and len(links) == n - len(set(joined(n, links)))
        root = np.array([i % 5 for i in range(n)])
        links = N.spanning_links(root, of, h, N.weight(times), 0.8)
        known = [(i, i % 5) for i in range(n)]
        assert joined(n, known + links) == joined(n, known + pairs) and len(links) < 5


def test_planted_families_against_brute_force(spark):
    rng = random.Random(7)
    passage = " ".join(family(rng, 1, 60, 0))
    docs = [*family(rng, 40, 90, 0.018), *family(rng, 15, 40, 0.01), *[passage + " " + x for x in family(rng, 12, 25, 1.0)], *family(rng, 20, 30, 1.0)]
    docs += docs[:5] + [None, "", "one two three", "one two three", "ONE two, three"]
    docs = list(enumerate(docs))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs)
    got = classes(df)
    assert {d: c for d, (c, _) in got.items()} == want
    assert all(n == sum(x == c for x in want.values()) for c, n in got.values())


def test_chunks_of_buckets_miss_nothing(spark):
    rng = random.Random(9)
    texts = [*family(rng, 40, 60, 0.02), *family(rng, 30, 60, 0.03)]
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(sorted(docs))
    for chunk in (3, 8, 256):
        assert {d: c for d, (c, _) in classes(df, chunk=chunk).items()} == want


def test_every_two_components_of_a_bucket_meet(spark):
    members = [(7, i, 50) for i in range(50)] + [(8, i, 12) for i in range(12)]
    buckets = spark.createDataFrame(members, "key long, num long, n long")
    roots = {i: (0 if i < 30 else i // 4 * 4) for i in range(50)}
    found = spark.createDataFrame(list(roots.items()), "node long, root long")
    rows = N.open_cells(buckets, found, 6).collect()
    assert {r.key for r in rows} == {7}
    cells = {}
    for r in rows:
        assert r.root == roots[r.num]
        cells.setdefault((r.lo, r.hi), set()).add(r.num)
    for i in range(50):
        for j in range(i):
            if roots[i] != roots[j]:
                assert any({i, j} <= c for c in cells.values())
    assert sum(i in c for i in range(30) for c in cells.values()) == 30 * 4  # 20 outside: 4 chunks


def test_ids_that_repeat_or_lack(spark):
    rng = random.Random(3)
    x, near_x = family(rng, 2, 60, 0.004)
    y, z = (family(rng, 1, 60, 0)[0] for _ in range(2))
    docs = [(1, x), (5, near_x), (5, y), (5, y), (None, z), (None, y), (None, near_x), (None, None), (6, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in N.keep_one_of_each(df).collect()), key=str)
    assert kept == sorted([(1, x), (5, y), (5, y), (None, z), (6, "")], key=str)
    got = sorted(((r.doc_id, r.class_id, r.class_size) for r in N.near_duplicate_classes(df).collect()), key=str)
    assert got == sorted([(1, 1, 3), (5, 1, 3), (None, 1, 3), (5, 5, 3), (5, 5, 3), (None, 5, 3), (None, None, 1), (None, 6, 2), (6, 6, 2)], key=str)


def test_awkward_rows(awkward, no_rows):
    rows = N.near_duplicate_classes(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r.class_id for r in rows}
    assert by[1] == by[2] == 1 and by[6] == by[7] == 6 and by[3] == by[4] == 3
    assert by[5] == 5 and by[9] == 9 and by[10] == 10
    kept = N.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 1, 3, 5, 6, None, 8, 9, 10, 11], key=str)
    assert N.near_duplicate_classes(no_rows).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 99), (99, 98), (200, 201), (205, 201), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in K.components(df).collect()}
    assert got == {**{i: 0 for i in range(21)}, 98: 98, 99: 98, 100: 98, 200: 200, 201: 200, 205: 200}
    assert K.components(df.limit(0)).count() == 0
