import random
from collections import defaultdict

from llm_cases import words
from pyspark.sql import functions as F

from tidemark.llm import mixing


def targets(sizes):
    """Shares by weight; whoever is over 3 times its size stops there, the rest share again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def check(df, rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    want = targets(sizes)
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    own = defaultdict(list)
    for i, text, source in rows:
        own[i, len(words(text))].append(source)
    taken, greatest = defaultdict(int), defaultdict(int)
    for r in found:
        key = (None if r["_id"] == -(2**63) else r["_id"], r.size)
        (source,) = {s for s in own[key] if sizes[s] == r.source_size and abs(want[s] - r.target) <= 1e-6 * (1 + want[s])} or {None}
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[source] += r.taken
        greatest[source] = max(greatest[source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= greatest[s] / 2 + 1e-6, (s, taken[s], want[s])


def test_targets_and_takings(spark):
    rng = random.Random(3)
    for spread in (1, 30):
        rows = []
        for i in range(600):
            source = rng.choice([None, "", "a", "B", "é", "𝔘", "z1", "z2"] + ["hot"] * 6)
            rows.append((i, "w " * (rng.randint(0, 40) * (spread if source == "hot" else 1)), source))
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        check(df, rows)
    again = [sorted(map(tuple, mixing.mix(df.repartition(n)).collect()), key=str) for n in (1, 9)]
    assert again[0] == again[1]


def test_longer_documents_are_favoured_and_extras_are_drawn(spark):
    rows = [(i, "w " * (10 if i % 2 else 1000), "a" if i < 3000 else "b") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(df, weights=(1, 2))
    share = {r.size: r.n for r in found.where("target < source_size").groupBy("size").agg(F.avg("copies").alias("n")).collect()}
    assert 0.4 < share[10] < share[1000] < 1
    assert abs(share[1000] / share[10] - (1 + 9 / 8) / (1 + 3 / 8)) < 0.2


def test_odd_rows(odd, no_rows):
    check(odd, [(r.doc_id, r.text, r.source) for r in odd.collect()])
    assert mixing.mix(no_rows).collect() == [] == mixing.mixed(no_rows).collect()
    blank = odd.where("doc_id BETWEEN 1 AND 3")
    assert mixing.mix(blank).where("taken <> 0 OR target <> 0").count() == 0 and mixing.mixed(blank).count() == 0
    found = mixing.mixed(odd)
    assert found.columns == [c for c in odd.columns if c != "copies"] + ["copies"]


def test_only_built_in_functions(odd):
    text = mixing.mix(odd)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
