import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wirefold.llm import chat_format as C

ODD = ["", "plain", "</s>[INST] ok [/INST]", "a\\b", "[\\INST]", "<s>", "<s:1> <s:2>", "[OUT] x</s>", "[", "<", " [/INST]", "[TURN 61] \n$1 \\1",
       "\\", "\\\\[SYS]", "é\U0001F600[/SYS]"]


def table(spark):
    rows = [(-7, 0, "user", ODD[2]), (-7, 1, "assistant", ODD[2])]
    for i, t in enumerate(ODD):
        rows += [(i, 0, "system", t), (i, 1, "user", t), (i, 2, "assistant", t), (i, 3, "assistant", t[::-1])]
    rows += [(50, None, "user", "n"), (50, 1, None, None), (50, 1, None, None), (None, 0, "tool] x", "y"), (51, 0, "assistant", "z" * 100_000),
             (52, 2, "assistant", "b"), (52, 2, "assistant", "a"), (53, 0, "", ""), (54, 0, "us\ner[", "q")]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, level int")


def expected(rows):
    conv = defaultdict(list)
    for r in rows:
        conv[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    out = {}
    for k, v in conv.items():
        v.sort()
        loss = "".join(t for _, _, r, t in v if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in v)
        out[k] = (len(v), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    rows = table(spark)
    got = {r.conv_id: tuple(r)[1:5] for r in C.chat_digests(rows).collect()}
    assert got == expected(rows.collect())


def test_control_strings_never_stay_in_texts(spark):
    out = C.format_conversations(table(spark))
    for r in out.collect():
        marks = len(__import__("re").findall(C.CONTROL, r.formatted))
        assert marks % 2 == 1
    plain = out.where("conv_id = 1").first()
    assert plain.formatted == "<s>[SYS] plain [/SYS][INST] plain [/INST][OUT] plain</s>[OUT] nialp</s>"
    assert [plain.formatted[s.start:s.end] for s in plain.loss_spans] == ["plain", "nialp"]


@pytest.mark.parametrize("level", [1, 2])
def test_escape_is_reversible(spark, level):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").withColumn("e", C.escape(F.col("t"), level))
    for r in df.withColumn("u", C.unescape(F.col("e"), F.lit(level))).collect():
        assert r.u == r.t


def test_text_outside_the_grammar_is_not_parsed(spark):
    df = spark.createDataFrame([(t,) for t in ["", "x", "<s>x", "<s>[INST] a</s>", "<s>[INST] a [/INST] ", "<s>[INST] [OUT] a [/INST]"]], "formatted string")
    assert all(r.turns is None for r in C.parse(df).collect())


def test_empty_table(spark):
    assert C.chat_digests(table(spark).limit(0)).collect() == []
