"""Whole chat examples, and what is read back from them."""

import random

from pyspark.sql import functions as F

from emberframe.llm import chat_format


def talk():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["<a>", "\\", "</turn>\n", "é b", "", "plain text"]) * rng.randint(1, 4)) for c in range(20) for t in range(rng.randint(1, 12))]
    return rows + [(50, t, ["user", "assistant"][t % 2], f"text {t}") for t in range(300)]


def brute(rows):
    """(conv_id, text, loss) of every reply, with all turns before it."""
    code = lambda t: t.replace("\\", "\\0").replace("<", "\\1").replace(">", "\\2")
    text, out = {}, []
    for c, _, role, said in sorted(rows):
        text[c] = text.get(c, "") + f"<turn {role}>\n{code(said)}\n</turn>\n"
        if role == "assistant":
            out.append((c, text[c], code(said)))
    return sorted(out)


def test_whole_examples(spark):
    rows = talk()
    made = chat_format.materialise(chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert sorted((r.conv_id, r.text, r.text[r.loss_start : r.loss_end]) for r in made.collect()) == brute(rows)


def test_read_back_sees_whole_examples(spark):
    """Turns and losses come from the whole examples: a context of another length shifts the losses, a lost one the turns."""
    rows = spark.createDataFrame(talk(), "conv_id long, turn long, role string, text string").where("conv_id = 50")
    good = chat_format.examples(rows).localCheckpoint()
    want = chat_format.read_back(good).first()
    assert [t.text for t in want.turns] == [f"text {t}" for t in range(300)] and want.losses == [f"text {t}" for t in range(1, 300, 2)]
    shifted = good.withColumn("context_chars", F.when(F.col("example") == 7, F.col("context_chars") - 1).otherwise(F.col("context_chars")))
    assert chat_format.read_back(shifted).first().losses != want.losses
    assert chat_format.read_back(good.where("example <> 7")).first().losses != want.losses
