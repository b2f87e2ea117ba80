import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from sitelake.llm import exact_dedup as E


def brute(rows):
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    keep = {t: max((d for d in ds if d is not None), default=None) for t, ds in by.items()}
    return sorted(((d, keep[t or ""], len(by[t or ""]), d == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_awkward_rows(awkward):
    assert got(E.exact_dedup(awkward)) == brute([(r.doc_id, r.text) for r in awkward.collect()])


def test_empty_table(no_rows):
    assert E.exact_dedup(no_rows).count() == 0
    assert E.keep_first_copies(no_rows).columns == no_rows.columns


def test_a_weak_digest_merges_nothing(awkward):
    weak = lambda x: F.unhex(F.lit("00")) if x is not None else None
    strong = [(r[0], r[1], r[2], r[3]) for r in got(E.exact_dedup(awkward))]
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got(E.exact_dedup(awkward, digest=weak))), key=str) == sorted(strong, key=str)


def test_hot_group_over_many_partitions(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text")).repartition(37)
    out = E.exact_dedup(docs)
    assert out.count() == 5000
    assert {tuple(r) for r in out.filter("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(4998, 1667)}


def test_kept_rows_keep_their_columns(awkward):
    out = E.keep_first_copies(awkward)
    assert out.columns == awkward.columns
    rows = out.collect()
    texts = [r.text or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in awkward.collect()})
    assert {r.doc_id for r in rows if r.text and r.text.startswith("Hello")} == {2}
    assert all(r.keep_id == "x" for r in rows)


def test_texts_that_share_an_id_keep_their_own_columns(spark):
    rows = [(None, "a", "en", 1), (None, "b", "fr", 2), (None, "b", "fr", 2), (7, "c", "de", 3), (7, "d", "es", 4), (5, "d", "it", 5), (7, None, None, 6)]
    out = E.keep_first_copies(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int").repartition(3))
    want = [(None, "a", "en", 1), (None, "b", "fr", 2), (7, "c", "de", 3), (7, "d", "es", 4), (7, None, None, 6)]
    assert got(out) == sorted(want, key=str)
    twice = spark.createDataFrame([(1, "a", "y"), (1, "a", "x")], "doc_id long, text string, lang string")
    assert got(E.keep_first_copies(twice)) == got(E.keep_first_copies(twice.orderBy("lang"))) == [(1, "a", "x")]


def test_main_path_is_native(awkward):
    plan = E.exact_dedup(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
