import random
import time
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelake.llm import sentencepiece_sa as S

PATH = public_tokenizers.path(S.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encode(texts):
    return [list(array("I", x)) for x in S.encode_texts(S.pieces(PATH), texts)]


def test_fixed_and_random_texts(library):
    rng = random.Random(2)
    texts = ["", " ", "  a  b ", "a\nb", "\n", "\n\n a", "é é ﬁ Ａ \xa0x\u3000y", "\x00a", "<s>", "<0x0A>", "▁a", "日本𠀋\U0001f600", "a" * 3000, " " * 50 + "x", "aaaa bbbb"]
    for alphabet in ("ab", "abc d", "the in g", "aAbBeE n\n", "日本語 のaéü", "𠀋 a\U0001f600", "0123456789", "  \t\n x"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    got = encode(texts)
    for t, ids in zip(texts, got):
        assert ids == library.encode(t), t
        assert S.decode_ids(S.pieces(PATH), array("I", ids).tobytes()) == library.decode(ids)


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(blacklist_categories=["Cs"]), max_size=60))
def test_any_text(text):
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert encode([text]) == [m.encode(text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(3, 31999), max_size=30))
def test_any_ids_decode_alike(ids):
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert S.decode_ids(S.pieces(PATH), array("I", ids).tobytes()) == m.decode(ids)


def test_bytes_outside_utf8_decode_one_by_one(library):
    p = S.pieces(PATH)
    for raw in (b"\xe1\x80", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xff\xc3", b"\xc3(", b"\xef\xbf\xbd\x80"):
        ids = [p.byte_id[b] for b in raw] + [p.id["a"]]
        assert S.decode_ids(p, array("I", ids).tobytes()) == library.decode(ids), raw


def test_pairs_fit_as_merging_says():
    p, rng = S.pieces(PATH), random.Random(8)
    ids = [i for i in p.searched_id.tolist() if S.SPACE not in p.text[i]]
    common = [i for i in ids if len(p.text[i]) < 4]
    pairs = [(rng.choice(pool), rng.choice(pool)) for pool in (ids, common) for _ in range(4000)]
    words = [p.text[i] for i in rng.sample(ids, 3000)]
    pairs += [(p.id[w[:k]], p.id[w[k:]]) for w in words for k in range(1, len(w)) if w[:k] in p.id and w[k:] in p.id]
    got = p.fit(*(np.array(c) for c in zip(*pairs)))
    want = [p.merge(p.text[a] + p.text[b])[0] == [p.text[a], p.text[b]] for a, b in pairs]
    stable = set(ids)
    assert [g for g, pair in zip(got.tolist(), pairs) if stable.issuperset(pair)] == [w for w, pair in zip(want, pairs) if stable.issuperset(pair)]


def test_long_runs_take_no_long(library):
    texts = ["a" + " " * 100_000 + "b", "x" * 100_000, "ab" * 30_000 + "\U0001f600" * 2000, "日" * 20_000, " " * 30_001]
    began = time.time()
    got = encode(texts)
    assert time.time() - began < 30
    assert got == [library.encode(t) for t in texts]
    assert not any(len(u) > S.LONG_UNIT for u in S.pieces(PATH).units)


@pytest.mark.parametrize("few", [0, 3, 10**9])
def test_offsets_at_once_or_edge_by_edge(library, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    rng = random.Random(6)
    texts = ["".join(rng.choice("the in ganoé\n日x") for _ in range(rng.randint(1, 80))) for _ in range(200)]
    units = sorted({u for t in texts for u in S.units_of(t)})
    made = S.encode_units(S.pieces(PATH), units)
    assert [list(array("I", b"".join(made[u] for u in S.units_of(t)))) for t in texts] == [library.encode(t) for t in texts]


def test_parts_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(S, "PART_BYTES", 10)
    texts = ["", None, "a" * 4, "é" * 3, "x" * 50, "", "y" * 10, "z", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "content"])
    parts = list(S.parts_of(batch))
    assert [i for part in parts for i in part.column(0).to_pylist()] == list(range(len(texts)))
    assert all(part.num_rows == 1 or sum(len((t or "").encode()) for t in part.column(1).to_pylist()) <= 10 for part in parts)
    assert [part.num_rows for part in parts] == [4, 1, 2, 2]


def test_awkward_rows(library, awkward, no_rows):
    both = S.decode_documents(S.encode_documents(awkward))
    rows = both.collect()
    in_one = S.encode_documents(awkward, decoded=True)
    assert sorted(map(str, in_one.collect())) == sorted(map(str, both.collect()))
    want = sorted(((r.doc_id, r.text or "", library.encode(r.text or "")) for r in awkward.collect()), key=str)
    assert sorted(((r.doc_id, r.content, list(array("I", bytes(r.ids)))) for r in rows), key=str) == want
    assert all(r.decoded == r.content for r in rows)
    assert S.decode_documents(S.encode_documents(no_rows)).count() == 0
