import random

from pyspark.sql import functions as F

from sitelake.llm import chat as C
from sitelake.llm.queries import op10_chat_format


def read_back(df):
    out = C.format_conversations(df)
    return {r.conv_id: r for r in out.select("conv_id", "formatted", "segments", C.parse_formatted(F.col("formatted")).alias("turns")).collect()}


def test_round_trip_and_mask(spark):
    rng = random.Random(5)
    bits = ["<|", "|>", "<", "|", "im_end", "<|im_end|>", "<|im_start|>assistant\n", "\n", "<|im_sep|>", "<||", "x", "é😀", "<|nl|>", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "sys<|im_end|>\ntem", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for c in range(60) for t in range(rng.randint(1, 9))]
    out = read_back(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for c in range(60):
        want = [(r, x) for cc, _, r, x in rows if cc == c]
        assert [(t.role, t.text) for t in out[c].turns] == want
        whole, at, masked = out[c].formatted, 0, []
        for s in out[c].segments:
            if s.loss:
                masked.append(whole[at : at + s.chars].replace("<||", "<|"))
            at += s.chars
        assert at == len(whole)
        assert masked == [x for r, x in want if r == "assistant"]


def test_adjacent_turns_of_a_role_are_one_message(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")]
    got = read_back(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))[1]
    assert got.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_awkward_rows(spark):
    rows = [(None, 0, None, None), (1, None, "user", "x"), (1, 0, "user", None), (1, 0, "user", None), (2, 5, "assistant", "long " * 40000), (2, 5, "assistant", "tie")]
    got = read_back(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string"))
    assert [(t.role, t.text) for t in got[None].turns] == [("", "")]
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "x"), ("user", ""), ("user", "")]
    assert [t.text for t in got[2].turns] == ["long " * 40000, "tie"]
    assert read_back(spark.createDataFrame([], "conv_id long, turn long, role string, text string")) == {}


def test_query_has_the_extra_conversation_and_is_native(spark, sf_dir):
    df = op10_chat_format(spark, sf_dir)
    r = df.filter("conv_id = -1").first()
    assert (r.n_turns, r.loss_chars) == (2, len("<|im_end|><|im_start|>assistant ok"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_loss_of_the_query_follows_the_mask(spark, sf_dir, monkeypatch):
    right = op10_chat_format(spark, sf_dir).filter("conv_id = -1").first()
    made = C.format_conversations
    flip = F.transform("segments", lambda s: F.struct(s["chars"].alias("chars"), (~s["loss"]).alias("loss")))
    monkeypatch.setattr(C, "format_conversations", lambda rows: made(rows).withColumn("segments", flip))
    wrong = op10_chat_format(spark, sf_dir).filter("conv_id = -1").first()
    assert right.loss_sha256 != wrong.loss_sha256 and right.loss_chars != wrong.loss_chars


def test_loss_texts_are_unescaped_one_by_one(spark):
    rows = [(1, 0, "assistant", "a<"), (1, 1, "assistant", "||b<|😀"), (1, 2, "user", "no"), (1, 3, "assistant", ""), (1, 4, "assistant", "é<||")]
    out = C.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert out.select(C.loss_text(F.col("formatted"), F.col("segments"))).first()[0] == "a<||b<|😀é<||"
