import random

from pyspark.sql import functions as F

from tidemark.llm import chat

PARTS = ["<|im_end|>", "<|im_start|>", "<\\|", "<", "|", "\\", "\n", "assistant", "\\n", "$1", "é𝔘", " "]


def test_escape_round_trip(spark):
    rng = random.Random(1)
    texts = [("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))),) for _ in range(800)]
    df = spark.createDataFrame(texts, "t string").select("t", chat.escape(F.col("t")).alias("e"))
    assert df.where(F.contains("e", F.lit("<|"))).count() == 0
    assert df.where(chat.unescape(F.col("e")) != F.col("t")).count() == 0
    assert df.select(F.count_distinct("t") == F.count_distinct("e")).first()[0]


def test_examples_say_the_conversation(spark):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))])
    rows = [
        (rng.choice([None, *range(30)]), rng.choice([None, *range(6)]), rng.choice(["user", "assistant", "assistant", None, "a\nb\\n<|"]), text())
        for _ in range(300)
    ]
    rows += [(77, 0, "assistant", "x" * 200_000), (77, 1, "user", "bye"), (77, 1, "user", "bye")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    found = chat.format_chats(df).select("*", chat.read_turns().alias("turns"), chat.loss_text().alias("loss")).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        talk = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        own = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.example)
        targets = [i for i, (role, _) in enumerate(talk) if role == "assistant"]
        ends = targets + [len(talk) - 1] * (not targets or targets[-1] != len(talk) - 1)
        assert [r.target for r in own] == targets + [None] * (len(ends) - len(targets))
        for r, end in zip(own, ends):
            assert [tuple(t) for t in r.turns] == talk[: end + 1]
            assert r.loss == (talk[end][1] if r.target is not None else "")
            if r.target is not None:
                assert r.formatted[r.loss_end :] == chat.END
            assert r.closing == (r is own[-1])
    assert chat.format_chats(df.limit(0)).collect() == []


def test_only_built_in_functions(spark):
    plan = chat.format_chats(spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string"))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
