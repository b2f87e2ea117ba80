import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sitelake.llm import maxent_lm as M
from sitelake.llm.queries import op6_lm_scores


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), b""]


def check(rows, docs, train):
    c = Counter()
    for d, t in docs:
        if train(d):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(docs)
    key = lambda d, t: (str(d), len(tokens(t)))
    for r, (d, t) in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.n_tokens)), sorted(docs, key=lambda x: key(*x)), strict=True):
        w = tokens(t)
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 1e-6


def random_weights(seed):
    rng = np.random.default_rng(seed)
    return M.Weights(rng.normal(size=(M.BOTH + M.TRIGRAMS, M.CLASSES)), rng.normal(size=(M.BOTH, M.TARGETS)))


def slow_logs(w, skip, last):
    """Natural logs of P(target | skip, last), from the definition."""
    rows = [0, M.LAST + last, M.SKIP + skip]
    c = sum(w.by_class[r] for r in [*rows, int(M.trigram_rows(np.array([skip]), np.array([last]))[0])]).astype(float)
    m = sum(w.member[r] for r in rows).astype(float).reshape(M.CLASSES, M.MEMBERS)
    return ((c - np.log(np.exp(c).sum()))[:, None] + m - np.log(np.exp(m).sum(1, keepdims=True))).ravel()


def test_tables_give_the_softmax_of_the_features():
    w, rng = random_weights(0), np.random.default_rng(1)
    skip, last = rng.integers(0, M.HISTORY, 40), rng.integers(0, M.HISTORY, 40)
    for s, l in zip(skip, last):
        got = w.log10(np.full(M.TARGETS, s), np.full(M.TARGETS, l), np.arange(M.TARGETS)) * np.log(10)
        assert np.allclose(got, slow_logs(w, s, l), atol=1e-4)
        assert abs(np.exp(got).sum() - 1) < 1e-4


def test_observed_minus_expected_is_the_slope():
    w, rng = random_weights(2), np.random.default_rng(3)
    skip, last, target = rng.integers(0, 3, 300), rng.integers(0, 4, 300), rng.integers(0, M.TARGETS, 300)
    likelihood = lambda: sum(slow_logs(w, s, l)[t] for s, l, t in zip(skip, last, target))
    seen = np.zeros((M.HISTORY, M.HISTORY, M.CLASSES))
    np.add.at(seen, (skip, last, target // M.MEMBERS), 1)
    by_class, member = np.zeros(w.by_class.shape), np.zeros(w.member.shape)
    for s in range(3):
        M.expected(w, s, seen[s], by_class, member)
    both = M.trigram_rows(skip, last)
    for rows in (np.zeros(300, int), M.LAST + last, M.SKIP + skip, both):
        np.add.at(by_class, (rows, target // M.MEMBERS), -1)
        if rows is not both:
            np.add.at(member, (rows, target), -1)
    for table, g in ((w.by_class, -by_class), (w.member, -member)):
        for row in (0, M.LAST + 2, M.SKIP + 1, *([int(both[0])] if table is w.by_class else [])):
            column = int(np.abs(g[row]).argmax())
            table[row, column] += 1e-4
            up = likelihood()
            table[row, column] -= 2e-4
            down = likelihood()
            table[row, column] += 1e-4
            assert abs((up - down) / 2e-4 - g[row, column]) < 1e-3 * max(1, abs(g[row, column]))


def test_scores_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 3000").limit(50).cache()
    train = F.col("doc_id") % 3 != 0
    rows = {r.doc_id: r.score for r in M.score_documents(docs, train, steps=3).collect()}
    model, counts = M.learn(docs.filter(train).select(F.col("text").cast("binary").alias("content")), steps=3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    c = Counter(t for d, x in texts.items() if d % 3 for t in tokens(x))
    assert {bytes(r.word): r.n for r in counts.collect()} == c
    order = sorted(c, key=lambda t: (-c[t], t))
    own, near = {t: i for i, t in enumerate(order[: M.OWN])}, {t: i for i, t in enumerate(order[: M.HISTORY_OWN])}
    ending = lambda t: zlib.crc32(t[-2:]) % M.SHARED
    target = lambda t: own.get(t, M.OWN + ending(t))
    history = lambda t: near.get(t, M.HISTORY_OWN + ending(t) % M.HISTORY_SHARED)
    held, kinds = Counter(), Counter()
    for t, n in c.items():
        held[target(t)] += n
        kinds[target(t)] += 1
    logs = {}
    for d, x in texts.items():
        total, before = 0.0, [b"", b""]
        for t in tokens(x):
            h = tuple(history(b) for b in before[-2:])
            if h not in logs:
                logs[h] = slow_logs(model.weights, *h)
            total += logs[h][target(t)] / math.log(10)
            if t not in own:
                total += math.log10((c[t] + 0.1) / (held[target(t)] + 0.1 * (kinds[target(t)] + 1)))
            before.append(t)
        assert abs(rows[d] - total) < 1e-4 * max(1, abs(total))


def test_words_beyond_the_broadcast_are_joined(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 150)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    rows = M.score_documents(docs, F.col("doc_id") % 2 == 0, steps=2).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], lambda d: d % 2 == 0)


def test_awkward_rows(awkward, no_rows):
    train = F.col("doc_id") % 10 != 0
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    rows = M.score_documents(awkward, train, steps=2).collect()
    check(rows, docs, lambda d: d is not None and d % 10 != 0)
    assert M.score_documents(no_rows, train, steps=1).count() == 0
    untrained = M.score_documents(awkward, F.lit(False), steps=1).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 for r in untrained)


def test_the_model_beats_the_base_on_held_out_documents(spark, sf_dir):
    out = op6_lm_scores(spark, sf_dir).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert out[2] > 0 and out[0] > out[1]


def test_each_step_raises_the_likelihood(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").cast("binary").alias("content"))
    counts = M.word_counts(docs)
    vocabulary, _, _, held = M.make_vocabulary(counts)
    cells = M.observed(M.observed_counts(docs, spark.sparkContext.broadcast(vocabulary)))
    assert cells[: M._BY_LAST].sum() == cells[M._BY_LAST + M._BY_SKIP :].sum() == held.sum()
    _, past = M.train(spark, cells, held, steps=6)
    assert all(b > a for a, b in zip(past, past[1:], strict=False))


def test_the_broadcast_words_are_the_most_frequent(spark, monkeypatch):
    monkeypatch.setattr(M, "FREQUENT", 5)
    counts = spark.createDataFrame([(bytes([97 + i]), n) for i, n in enumerate([100, 7, 7, 7, 50, 1, 1, 1, 3])], "word binary, n long")
    assert M.frequent_words(counts) == [(b"a", 100), (b"e", 50), (b"b", 7), (b"c", 7), (b"d", 7)]
    assert M.frequent_words(counts.filter("n = 1").union(counts.filter("n = 1"))) == []
