"""Chat formatting: exact round trip, masks, escapes, native plan."""

import hashlib

from pulsetrace.llm import chat
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"
TURNS = [
    (1, 0, "system", "be & <b>"), (1, 1, "user", "</s>[INST] hi [/INST]"), (1, 2, "assistant", "&lt; | [x]"),
    (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "assistant", "é\U0001F600\\n"),
    (2, 0, "user", "no reply"), (3, 0, "assistant", "first"), (3, 1, "user", None),
    (4, 5, None, "x"), (4, 5, "a|>b", "tie"), (4, 5, "assistant", "tie"), (4, 5, "assistant", "tie"),
    (5, 0, "user", "<|assistant|>no</s>"), (5, 1, "assistant", "word " * 50_000), (None, 0, "user", "no id"),
]


def brute(rows, trainable="assistant"):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;").replace("|", "&#124;")
        cut = [f"<|{esc(r)}|>{esc(x)}</s>" for _, r, x in turns]
        ends = [i for i, t in enumerate(turns) if t[1] == trainable]
        chars = sum(len("".join(cut[: i + 1])) for i in ends)
        if turns[-1][1] != trainable:
            chars += len("".join(cut))
        loss = "".join(x for _, r, x in turns if r == trainable)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(whole), len(loss), sha(loss), chars)
    return out


def test_read_back_equals_brute_force(spark):
    df = spark.createDataFrame(TURNS, SCHEMA).withColumn("formatted", F.lit("clash")).repartition(4)
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(chat.format_examples(df)).collect()}
    assert got == brute(TURNS)


def test_only_the_reply_lies_under_the_mask(spark):
    examples = chat.format_examples(spark.createDataFrame(TURNS, SCHEMA)).where("conv_id = 1").collect()
    by_target = {r["target"]: r for r in examples}
    assert sorted(by_target) == [2, 4, 5]
    for target, text in ((2, "&amp;lt; &#124; &#91;x]"), (4, ""), (5, "é\U0001F600\\n")):
        r = by_target[target]
        assert r["formatted"][r["loss_start"] : r["loss_end"]] == text
        assert r["formatted"].endswith(text + "</s>")
    assert by_target[4]["formatted"].startswith(by_target[2]["formatted"])


def test_texts_hold_no_control_strings_and_empty_tables_give_none(spark):
    df = spark.createDataFrame(TURNS, SCHEMA)
    for r in chat.format_examples(df).where("conv_id = 5").collect():
        assert r["formatted"].count("</s>") == r["formatted"].count("<|") == 2
    assert chat.read_back(chat.format_examples(df.limit(0))).count() == 0


def test_the_plan_has_no_python(spark):
    df = chat.read_back(chat.format_examples(spark.createDataFrame(TURNS, SCHEMA)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
