import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.llm import langid as L
from sitelake.llm.queries import op2_language_id


def code_length(grams, order, text):
    """Brute force: method C with full exclusion, byte by byte."""
    by = {}
    for g, n in grams.items():
        for d in range(order + 1):
            c = by.setdefault(g[order - d : order], {})
            c[g[order]] = c.get(g[order], 0) + n
    total, padded = 0.0, b"\n" * order + text
    for i in range(order, len(padded)):
        mass, gone, b = 1.0, set(), padded[i]
        for d in range(order, -1, -1):
            c = {s: n for s, n in by.get(padded[i - d : i], {}).items() if s not in gone}
            if not c:
                continue
            t, k = sum(c.values()), len(c)
            if b in c:
                total -= math.log2(mass * c[b] / (t + k))
                break
            mass *= k / (t + k)
            gone |= set(c)
        else:
            total -= math.log2(mass / (256 - len(gone)))
    return total


def test_code_lengths_are_exact():
    texts = {"en": [b"the cat sat on the mat", b"then the hat"], "fr": ["le chat était là".encode(), b"la la le"]}
    counts = {k: L.ngrams(v, 3) for k, v in texts.items()}
    model = L.build(counts, 3)
    asked = [b"the hat", "été ☃ \x00".encode(), b"", b"zzzz", b"t" * 70]
    got = L.code_lengths(model, asked)
    for i, t in enumerate(asked):
        for j, lang in enumerate(model.langs):
            assert abs(got[i, j] - code_length(counts[lang], 3, t)) < 1e-3 * max(1, got[i, j])


def test_probabilities_add_up_to_one():
    model = L.build({"a": L.ngrams([b"abracadabra"], 3), "b": L.ngrams([b"banana bandana"], 3)}, 3)
    others = 256 - len({*b"abracadabra", *b"banana bandana", 10})
    p = np.exp2(-model.bits.astype(float))
    assert np.allclose(p[:, :-1].sum(1) + others * p[:, -1], 1, atol=1e-4)


def test_long_texts_are_scored_whole(monkeypatch):
    model = L.build({"a": L.ngrams([b"abracadabra"], 3), "b": L.ngrams([b"banana"], 3)}, 3)
    texts = [b"", b"abra" * 50, b"x", b"banana" * 33]
    whole = L.code_lengths(model, texts)
    monkeypatch.setattr(L, "_STEP", 7)
    assert np.allclose(L.code_lengths(model, texts), whole, rtol=1e-5)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = op2_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out) > 0
    assert all(0 <= r.score <= 1 for r in out)


def test_awkward_rows(awkward, no_rows):
    model = L.train_model(awkward, train=F.lit(True))
    assert model.langs == ["de", "en", "fr"] or model.langs == ["de", "en"]
    out = L.predict_language(awkward, model)
    assert out.columns == [c for c in awkward.columns if c != "lang_pred"] + ["lang_pred", "lang_score"]
    rows = out.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und" and r.lang_score == 0) != letters
    assert L.predict_language(no_rows, model).count() == 0
    nothing = L.train_model(no_rows, train=F.lit(True))
    assert {r.lang_pred for r in L.predict_language(awkward, nothing).collect()} == {"und"}


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    assert 0 < L.train_rows(docs, F.lit(True), "doc_id", "text", "lang", 128).count() <= 128


def test_rows_that_repeat_an_id_stay_in_the_bound(spark):
    docs = spark.range(2000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 400).alias("text"), F.lit("en").alias("lang"))
    rows = [r.content for r in L.train_rows(docs, F.lit(True), "doc_id", "text", "lang", 128).collect()]
    assert 0 < len(rows) == len(set(rows)) <= 128


def test_too_many_languages_are_an_error(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.concat(F.lit("l"), "id").alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        L.train_rows(docs, F.lit(True), "doc_id", "text", "lang", 128)


def test_predictions_equal_brute_force(spark):
    rng = random.Random(5)
    letters = {"aa": "abcde éè", "bb": "abcxyz ß", "cc": "deklmn  "}
    docs = [(i, "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 30))), lang) for i in range(80) for lang in [rng.choice(list(letters))]]
    docs += [(90, None, "aa"), (91, "12 34", "bb"), (92, "abc", None), (93, "", "cc")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    learn = F.col("doc_id") % 4 != 2
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in L.predict_language(df, L.train_model(df, train=learn)).collect()}
    counts = {lang: L.ngrams([L._bytes(t) for i, t, own in docs if own == lang and t is not None and i % 4 != 2], 3) for lang in letters}
    for i, t, _ in docs:
        if not any(c.isalpha() for c in t or ""):
            assert got[i] == ("und", 0.0)
            continue
        bits = {lang: code_length(counts[lang], 3, L._bytes(t)) for lang in letters}
        best = min(sorted(bits), key=bits.get)
        assert got[i][0] == best
        assert abs(got[i][1] - 1 / sum(2 ** (bits[best] - b) for b in bits.values())) < 1e-3
