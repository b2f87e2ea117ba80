import random
import zlib
from array import array

import public_tokenizers
from test_near_dedup import brute, family
from tokenizers import Tokenizer

import corpus_pipeline as C
from sitelake.llm.queries import ORACLE_SQL, QUERIES


def test_stages_on_awkward_documents(spark, awkward, sf_dir):
    docs = awkward
    for name, stage in C.STAGES[:-1]:
        before = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == before, name
    rows = docs.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted([2, 7, None, 9, 10, 11], key=str)
    packed = C.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == 6


def test_run(spark, sf_dir):
    out = C.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = out.select("doc_id").distinct().count()
    assert 0.8 * docs.count() < kept < docs.count()
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024


def test_language_keeps_texts_where_no_label_is_set(spark, sf_dir):
    docs = spark.createDataFrame([(1, "eins zwei drei", None), (2, "12 34", None), (3, None, None), (None, "four five", None)], "doc_id long, text string, lang string")
    assert sorted((r.text for r in C.language(spark, docs, sf_dir).collect())) == ["eins zwei drei", "four five"]


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    texts = [*family(rng, 12, 70, 0.01), *family(rng, 6, 50, 0.02), *family(rng, 10, 40, 1.0), None, "", "12 34 56", "one two", "One, two!"]
    texts += texts[:4] + texts[20:22] + ["long words " * 1500]
    docs = [(i, t, rng.choice(["en", "de", None]), f"s{i % 3}") for i, t in enumerate(texts)]
    rng.shuffle(docs)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spoken = {d: t for d, t, *_ in docs if any(c.isalpha() for c in t or "")}
    single = {t: max(d for d in spoken if spoken[d] == t) for t in spoken.values()}
    left = sorted((d, t) for t, d in single.items())
    root = brute(left)
    kept = [(d, t) for d, t in left if root[d] == d]
    assert len(docs) > len(spoken) > len(left) > len(kept) > 10
    rows = C.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {d for d, _ in kept}
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: [*full.encode(t, add_special_tokens=False).ids, 2] for d, t in kept}
    at: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == at.get(r.doc_id, 0) and r.ids_crc32 == zlib.crc32(array("I", ids).tobytes())
        at[r.doc_id] = r.start + r.length
    assert at == {d: len(x) for d, x in want.items()}
    places: dict = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 1024 and len(places) <= sum(at.values()) // 1024 + 2
