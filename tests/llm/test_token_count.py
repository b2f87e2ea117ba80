import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sitelake.llm import token_count as T
from sitelake.runtime import shared_path

PATH = public_tokenizers.path(T.TOKENIZER)


def want(text):
    return len((text or "").encode()), len(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids)


def test_awkward_rows_and_cache(spark, awkward, no_rows):
    cache = shared_path(spark, "test_cache")
    rows = T.count_tokens(awkward, cache).collect()
    expected = sorted(((r.doc_id, *want(r.text)) for r in awkward.collect()), key=str)
    assert sorted((tuple(r) for r in rows), key=str) == expected
    stored = spark.read.parquet(cache)
    first = stored.count()
    assert first == stored.select("digest").distinct().count()
    again = T.count_tokens(awkward, cache).collect()
    assert sorted((tuple(r) for r in again), key=str) == expected
    assert spark.read.parquet(cache).count() == first  # all were hits
    assert T.count_tokens(no_rows, cache).count() == 0
    more = awkward.select("doc_id", "text").unionByName(spark.createDataFrame([(99, "quite new words")], "doc_id long, text string"))
    assert T.count_tokens(more, cache).count() == awkward.count() + 1
    assert spark.read.parquet(cache).count() == first + 1


def test_another_tokenizer_version_misses(spark, awkward):
    cache = shared_path(spark, "test_cache")
    T.count_tokens(awkward.limit(3), cache).collect()
    other = public_tokenizers.path("byte_bpe_50k.json")
    T.count_tokens(awkward.limit(3), cache, tokenizer=other).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2


def test_counter_forgets_but_stays_right(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 20)
    T._loaded.clear()
    count, full = T.counter(PATH), Tokenizer.from_file(PATH)
    texts = [f"word{i} it's {i}x\n{i * 7} Ünï <|endoftext|>y \u00a0 \x1c z" for i in range(60)]
    for k in range(0, 60, 7):
        assert count(texts[k : k + 7]) == [len(full.encode(t, add_special_tokens=False).ids) for t in texts[k : k + 7]]
    T._loaded.clear()


def test_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = T.count_tokens(docs, shared_path(spark, "test_cache")).join(docs.select("doc_id", "text"), "doc_id").orderBy(F.desc("n_bytes")).limit(30).collect()
    assert all((r.n_bytes, r.n_tokens) == want(r.text) for r in rows)


def test_a_tokenizer_that_keeps_white_space(spark, awkward):
    other = public_tokenizers.path("byte_bpe_50k.json")
    full = Tokenizer.from_file(other)
    assert T.drops_space(T.load(PATH)) and not T.drops_space(T.load(other))
    rows = T.count_tokens(awkward, shared_path(spark, "test_cache"), tokenizer=other).collect()
    want_ = [(r.doc_id, len((r.text or "").encode()), len(full.encode(r.text or "", add_special_tokens=False).ids)) for r in awkward.collect()]
    assert sorted((tuple(r) for r in rows), key=str) == sorted(want_, key=str)
