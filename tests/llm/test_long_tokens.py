"""Decontamination where a few shingles weigh or count far more than the others."""

import random

from test_decontaminate import brute, got

from tidemark.llm import decontaminate


def compare(spark, docs, items):
    want = brute(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = got(decontaminate.contaminated(df, bench))
    assert {r[:2] for r in found} == {r[:2] for r in want}
    assert len(want) >= len(items) // 2
    return want


def test_long_tokens(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    token = lambda n: "".join(rng.choice(letters) for _ in range(n))
    docs, items = [], []
    for n_words, size in [(100, 60), (150, 100), (200, 150), (200, 200)]:
        for _ in range(12):
            i = len(items)
            item = [token(rng.randint(2, 9)) for _ in range(n_words)]
            item[n_words // 2] = token(size)
            leak = list(item)
            leak[n_words // 2] = token(max(3, size // 4))
            items.append((i, " ".join(item)))
            docs.append((i, " ".join([token(5), *leak, token(4)])))
    want = compare(spark, docs, items)
    assert len(want) > 30


def test_repeated_shingles(spark):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    docs, items = [], []
    for i in range(20):
        own = words(120)
        items.append((i, " ".join(own + ["ha"] * 24)))
        docs.append((i, " ".join(words(3) + own + ["ha"] * 6 + words(40))))
    compare(spark, docs, items)
