import numpy as np

from sitelake.llm import mih as H


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, vec string")


def brute(rows, k=20):
    fine = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == len(rows[0][1]):
            fine.setdefault(i, np.array(v, np.float32).astype(float))
    ids = np.array(sorted(fine))
    x = np.stack([fine[i] for i in ids])
    out = {}
    for n, q in enumerate(ids):
        if q % 20 == 0:
            s = x @ x[n]
            order = [m for m in np.lexsort((ids, -s)) if m != n][:k]
            out[int(q)] = [(int(ids[m]), float(s[m])) for m in order]
    return out


def test_pigeonhole_probing_finds_every_code_in_the_radius():
    codes = np.random.default_rng(0).integers(0, 256, (3000, 8), dtype=np.uint8)
    tables = H.SubstringTables(codes)
    for radius in (0, 7, 15, 20):
        for q in codes[:5] ^ np.uint8(3):
            assert sorted(tables.within(q, radius)) == sorted(np.flatnonzero(H.hamming(codes, q) <= radius))


def test_recall_scores_and_ranks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 32))
    x = centres[rng.integers(0, 30, 4000)] + 0.6 * rng.normal(size=(4000, 32))
    x *= rng.uniform(0.3, 3, (4000, 1))  # the largest product, not the smallest angle
    x[1000:1300] = x[1000]
    rows = [(i, [float(np.float32(c)) for c in v], "s", "v") for i, v in enumerate(x)]
    got = {}
    for r in H.nearest(frame(spark, rows), lambda c: c % 20 == 0, row_block=1500, query_block=90).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want, hits = brute(rows), 0
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        exact = dict(want[q])
        hits += sum(i in exact for _, i, _ in found)
        for _, i, s in found:
            assert i != q and (i not in exact or abs(s - exact[i]) < 1e-9)
    assert hits >= 0.9 * 20 * len(want)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], "s", "v"), (0, [1.0, 0.0], "s", "v"), (20, [0.5, 0.5], "s", "v"), (1, [2.0, 0.0], "s", "v"), (2, [2.0, 0.0], "s", "v"), (3, None, "s", "v"), (4, [0.0, 0.0], "s", "v"), (40, [float("nan"), 1.0], "s", "v"), (5, [None, 1.0], "s", "v"), (6, [1.0, 2.0, 3.0], "s", "v"), (None, [1.0, 1.0], "s", "v"), (60, [float("inf"), 1.0], "s", "v")]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in H.nearest(frame(spark, rows), lambda c: c % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.5), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.5)]
    assert H.nearest(frame(spark, []), lambda c: c % 20 == 0).count() == 0


def test_ids_that_repeat_take_their_least_vector(spark):
    rows = [(0, [1.0, 1.0], "s", "v"), (1, [3.0, 0.0], "s", "v"), (1, [2.0, 5.0], "s", "v"), (2, [1.0, 0.5], "s", "v"), *[(3, [9.0, -9.0 - i], "s", "v") for i in range(50)]]
    for parts in (1, 7):
        got = [(r.vec_id, r.score) for r in H.nearest(frame(spark, rows).repartition(parts), lambda c: c % 20 == 0).orderBy("rank").collect()]
        assert got == [(1, 7.0), (2, 1.5), (3, 9.0 - 58.0)]


def test_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    hits = sum(r.vec_id in dict(want[r.query_id]) for r in H.nearest(df, lambda c: c % 20 == 0).collect())
    assert hits >= 0.9 * 20 * len(want)
