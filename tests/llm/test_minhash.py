import random
from itertools import combinations

import pyarrow as pa
import pytest
from llm_cases import ascii_lower, words

from tidemark.llm import minhash


def shingles(text, k):
    w = words(ascii_lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[root(a)] = root(b)
    found = []
    for n, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(n) and rows[m][0] is not None]
        least = min(ids, default=None)
        found.append((i, len(sets[n]), least, i == least))
    return sorted(found, key=str)


def got(df):
    return sorted(
        ((None if r["_id"] == -(2**63) else r["_id"], r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str
    )


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_groups_of_edited_copies(spark, k, percent):
    """Copies with more and more edits: many miss their bucket's least node and link with others."""
    rng = random.Random(k)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = []
    for group, size in ((0, 90), (1, 40), (2, 5), (3, 2)):
        chain = [rng.choice(vocabulary) for _ in range(70)]
        for _ in range(size):
            copy = list(chain)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.1:
                chain = copy
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for i in range(40)]
    rng.shuffle(rows)
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    rows += [(len(rows) + n, rows[n][1].upper()) for n in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(minhash.near_duplicates(df, shingle=k, percent=percent)) == brute(rows, k, percent)


def test_small_blocks_and_odd_rows(spark, odd, no_rows, monkeypatch):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(minhash.near_duplicates(odd)) == brute(rows, 5, 80)
    assert minhash.near_duplicates(no_rows).collect() == []
    assert minhash.drop_near_duplicates(no_rows).collect() == []
    stay = minhash.drop_near_duplicates(odd)
    assert stay.columns == odd.columns
    assert stay.where("doc_id = 9").count() == 1 and stay.where("doc_id IN (8, 11)").count() == 0
    monkeypatch.setattr(minhash, "BLOCK", 3)
    test_groups_of_edited_copies(spark, 3, 85)


def test_sets_that_share_half_a_hash_stay_apart(spark, monkeypatch):
    sketch = minhash._sketch

    def halved(shingle, hashes):
        run = sketch(shingle, hashes)

        def coarse(batches):
            for batch in run(batches):
                few = pa.array([None if n is None else n % 3 for n in batch.column("node").to_pylist()], pa.int64())
                yield batch.set_column(batch.schema.get_field_index("node"), "node", few)

        return coarse

    monkeypatch.setattr(minhash, "_sketch", halved)
    test_groups_of_edited_copies(spark, 3, 85)


def test_bounds_miss_no_more_than_promised():
    import math

    for hashes, percent in ((120, 85), (108, 80)):
        alive, lost, done = {0: 1.0}, 0.0, 0
        for n, least in minhash.least_matches(hashes, percent, minhash.MISS):
            step, after = n - done, {}
            for m, p in alive.items():
                for j in range(step + 1):
                    t = percent / 100
                    after[m + j] = after.get(m + j, 0) + p * math.comb(step, j) * t**j * (1 - t) ** (step - j)
            lost += sum(p for m, p in after.items() if m < least)
            alive, done = {m: p for m, p in after.items() if m >= least}, n
        assert lost < 1e-4
